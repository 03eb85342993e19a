"""As-of and interval joins, and the newest row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerwatch.functions.signals import micros
from ledgerwatch.operators.segments import SEGMENT_ROWS, cut_points, prefix_scan


def dedup_latest(df: DataFrame, keys: list[str], newest: list[Column]) -> DataFrame:
    """The first row per key in the order ``newest``.

    The rank filter also runs before the shuffle, so many copies of one key do not travel.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*newest))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def latest_per_user(
    snapshots: DataFrame, as_of, ttl_hours: float, user: str = "user_id", ts: str = "computed_at", tie: str = "txn_id"
) -> DataFrame:
    """The online view: each user's newest snapshot at ``as_of``, unless it has expired."""
    oldest = F.lit(as_of) - F.make_dt_interval(secs=F.lit(ttl_hours * 3600).cast("decimal(18,6)"))
    live = snapshots.where((F.col(ts) <= F.lit(as_of)) & (F.col(ts) >= oldest))
    return dedup_latest(live, [user], [F.desc(ts), F.desc(tie)])


def asof_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_ts: str,
    right_ts: str,
    keep: list[str],
    max_age_us: int | None = None,
    tie: str = "txn_id",
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """All rows of ``left`` with ``keep`` from the newest row of ``right`` at or before them.

    Both sides are merged in time order and the last right row is carried forward,
    one shuffle in place of a range join. A right row at the same instant is visible.
    Unmatched or outdated rows get nulls and ``matched`` false.
    """
    found = F.struct(*[F.col(c) for c in keep], micros(right_ts).alias("_at"))
    updates = right.select(
        F.col(key).alias("_key"),
        micros(right_ts).alias("position"),
        F.struct(F.lit(0).alias("side"), F.col(tie).cast("string").alias("id")).alias("_tie"),
        found.alias("found"),
    )
    asks = left.select(
        F.col(key).alias("_key"),
        micros(left_ts).alias("position"),
        F.struct(F.lit(1).alias("side"), F.lit("").alias("id")).alias("_tie"),
        F.struct(*[F.col(c) for c in left.columns]).alias("row"),
    )
    moves = updates.unionByName(asks, allowMissingColumns=True)
    cuts = cut_points(moves.select("_key", "position"), ["_key"], "position", segment_rows)
    rows = prefix_scan(moves, ["_key"], "position", lasts=["found"], tie="_tie", cuts=cuts)
    rows = rows.where(F.col("row").isNotNull())
    fresh = F.col("found").isNotNull()
    if max_age_us is not None:
        fresh = fresh & (F.col("position") - F.col("found._at") <= max_age_us)
    return rows.withColumn("matched", F.coalesce(fresh, F.lit(False))).select(
        "row.*", *[F.when(F.col("matched"), F.col(f"found.{c}")).alias(c) for c in keep], "matched"
    )


def interval_join(
    txns: DataFrame, labels: DataFrame, min_hours: float, max_hours: float, watermark: str | None = None
) -> DataFrame:
    """Labels joined to their transaction when confirmed within the delay bounds after it.

    With ``watermark`` both inputs may be streams; the time bounds let Spark drop old state.
    """
    right = labels.select(F.col("txn_id").alias("label_txn_id"), "is_fraud", "confirmed_at")
    if watermark:
        txns = txns.withWatermark("txn_timestamp", watermark)
        right = right.withWatermark("confirmed_at", watermark)
    low = F.expr(f"txn_timestamp + make_dt_interval(0, 0, 0, {min_hours * 3600})")
    high = F.expr(f"txn_timestamp + make_dt_interval(0, 0, 0, {max_hours * 3600})")
    match = (
        (F.col("txn_id") == F.col("label_txn_id"))
        & (F.col("confirmed_at") >= low)
        & (F.col("confirmed_at") <= high)
    )
    return txns.join(right, match).drop("label_txn_id")
