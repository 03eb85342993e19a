"""Behavioural features over a user's own history.

The history of a transaction at ``t`` is ``(t - 24 h, t)`` for the day window and
``[t - 1 h, t)`` for the hour window: earlier microseconds only, so the result
does not depend on arrival order. Velocities and merchant counts add the current
transaction; mean, spread and z-score do not.

A sliding frame would revisit the whole frame for every row. Instead every
transaction enters the running totals of its user once and leaves them once per
window, so the work is linear in the rows however busy a user is. Amounts are
summed as exact decimals in millionths: nothing is left behind when they leave.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ledgerwatch.functions.signals import micros, ratio, rounded, with_direct_signals, zscore
from ledgerwatch.operators.segments import SEGMENT_ROWS, by_weight, cut_points, neighbours, prefix_scan
from ledgerwatch.schema import (
    DAY_US,
    FEATURE_COLUMNS,
    HISTORY_TTL_SECONDS,
    HOUR_US,
    TRAVEL_MAX_SECONDS,
    US_PER_SECOND,
)

_SCALE = 1_000_000
# Rows of a task that orders the rows of ordinary users.
TASK_ROWS = 200_000
# What each family of features sums up; a family that is not asked for costs nothing.
_TOTALS = {
    "velocity": ["n_24h", "n_1h"],
    "amount": ["n_24h", "s1", "s2"],
    "merchants": ["m_24h", "m_1h"],
    "last": [],
}
FAMILIES = tuple(_TOTALS)


@dataclass(frozen=True)
class Columns:
    """Column names, so that the operators run on any table with an entity, a time and a value."""

    txn: str = "txn_id"
    user: str = "user_id"
    ts: str = "txn_timestamp"
    amount: str = "amount"
    merchant: str = "merchant_id"
    country: str = "ip_country"


def _units(amount: Column) -> Column:
    return F.round(amount * _SCALE).cast("decimal(24,0)")


def _mean_and_std(n: Column, s1: Column, s2: Column) -> tuple[Column, Column]:
    """Mean and population deviation from exact sums of millionths.

    The squares are taken around the rounded mean, in decimal arithmetic, so equal
    amounts give exactly 0.
    """
    centre = F.coalesce(F.round(F.try_divide(s1, n), 0), F.lit(0)).cast("decimal(24,0)")
    rest = ratio(s1 - n * centre, n)
    spread = ratio(s2 - 2 * centre * s1 + n * centre * centre, n)
    variance = spread - rest * rest
    mean = F.coalesce(ratio(s1, n) / _SCALE, F.lit(0.0))
    std = F.when(n >= 2, F.sqrt(F.greatest(variance, F.lit(0.0))) / _SCALE).otherwise(F.lit(0.0))
    return mean, std


def _base_rows(df: DataFrame, cols: Columns, events: DataFrame | None) -> DataFrame:
    """One row per transaction and one per dated event of a user, in one table to shuffle once."""
    row = F.struct(*[F.col(c) for c in df.columns])
    base = df.select(
        F.col(cols.user).alias("_user"),
        F.col(cols.txn).alias("_txn"),
        micros(cols.ts).alias("_us"),
        F.col(cols.merchant).alias("_merchant"),
        F.col(cols.country).alias("_country"),
        _units(F.col(cols.amount)).alias("_a"),
        row.alias("_row"),
    )
    if events is None:
        return base
    # Moves act strictly after their position; events count at their own instant.
    dated = events.withColumn("position", F.col("position") - 1).withColumnRenamed("position", "_us")
    return base.unionByName(dated, allowMissingColumns=True)


def _moves(near: DataFrame, families: tuple[str, ...], extras: list[str]) -> DataFrame:
    """Each transaction as a query row plus the moves that open and close its windows.

    A move takes effect for positions above its own. Events pass through as they are.
    """
    us = F.col("_us")
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    a = F.coalesce(F.col("_a"), F.lit(0).cast("decimal(24,0)"))
    enters: dict[str, Column] = {"row": F.col("_row")}
    leaves_day: dict[str, Column] = {}
    leaves_hour: dict[str, Column] = {}
    if "velocity" in families or "amount" in families:
        enters["n_24h"], leaves_day["n_24h"] = one, -one
    if "velocity" in families:
        enters["n_1h"], leaves_hour["n_1h"] = one, -one
    if "amount" in families:
        value, square = a.cast("decimal(38,0)"), (a * a).cast("decimal(38,0)")
        enters |= {"s1": value, "s2": square}
        leaves_day |= {"s1": -value, "s2": -square}
    if "last" in families:
        enters["seen"] = F.struct(us.alias("us"), F.col("_country").alias("country"))
    if "merchants" in families:
        prev, nxt = F.col("prev_pos"), F.col("next_pos")

        def flag(condition: Column) -> Column:
            return F.when(F.col("last_at_pos") & condition, one).otherwise(none)

        # A merchant stays in the window while its next visit comes before the previous one has left.
        enters |= {
            "m_24h": flag(prev.isNull() | (prev <= us - DAY_US)),
            "m_1h": flag(prev.isNull() | (prev < us - HOUR_US)),
            # The current merchant counts once more only if the history does not hold it already.
            "new_24h": F.when(prev > us - DAY_US, none).otherwise(one),
            "new_1h": F.when(prev >= us - HOUR_US, none).otherwise(one),
        }
        leaves_day["m_24h"] = -flag(nxt.isNull() | (nxt >= us + DAY_US))
        leaves_hour["m_1h"] = -flag(nxt.isNull() | (nxt > us + HOUR_US))

    # 0 the transaction, 1 and 2 its leaving of the day and of the hour, 3 an event.
    kind = F.col("_kind")
    moves = [F.lit(0)] + [F.lit(k) for k, m in ((1, leaves_day), (2, leaves_hour)) if m]
    choice = F.array(*moves)
    if extras:
        choice = F.when(F.col("_row").isNull(), F.array(F.lit(3))).otherwise(choice)
    position = us + F.when(kind == 1, DAY_US - 1).when(kind == 2, HOUR_US).otherwise(0)

    def by_kind(c: str) -> Column:
        value = F.when(kind == 0, enters[c])
        for k, m in ((1, leaves_day), (2, leaves_hour)):
            if c in m:
                value = value.when(kind == k, m[c])
        return value

    return near.select("*", F.explode(choice).alias("_kind")).select(
        "_user", "_txn", position.alias("position"), *[by_kind(c).alias(c) for c in enters], *extras
    )


def behaviour(
    df: DataFrame,
    cols: Columns = Columns(),
    travel_seconds: float = TRAVEL_MAX_SECONDS,
    history_seconds: float = HISTORY_TTL_SECONDS,
    segment_rows: int = SEGMENT_ROWS,
    families: tuple[str, ...] = FAMILIES,
    user_events: DataFrame | None = None,
    event_totals: list[str] = (),
    event_lasts: list[str] = (),
) -> DataFrame:
    """All input columns plus velocity, amount, merchant, gap and travel features.

    ``families`` limits the work to part of them.
    ``user_events`` are further dated facts per user, ``(_user, position, *event_totals,
    *event_lasts)``: counts to sum up, and states to look up, to and including the instant of
    each transaction. They ride on the same shuffle.
    """
    extras = [*event_totals, *event_lasts]
    totals = list(dict.fromkeys(c for f in families for c in _TOTALS[f]))
    lasts = ["seen"] if "last" in families else []
    times = df.select(F.col(cols.user).alias("_user"), micros(cols.ts).alias("_us"))
    cuts = cut_points(times, ["_user"], "_us", segment_rows)
    # A number of one's own keeps the memory of a task the same at any size; small inputs are left to adaptive execution.
    tasks = df.count() // TASK_ROWS
    places = [tasks] if tasks > df.sparkSession.sparkContext.defaultParallelism else []

    def run(rows: DataFrame, cuts: DataFrame | None) -> DataFrame:
        if cuts is None:
            # Placed by user once; all windows below only sort.
            rows = rows.repartition(*places, "_user")
        if "merchants" in families:
            rows = neighbours(rows, ["_user", "_merchant"], "_us", "_txn", cuts, ["_user"])
        return prefix_scan(
            _moves(rows, families, extras),
            ["_user"],
            "position",
            totals=[*totals, *event_totals],
            lasts=[*lasts, *event_lasts],
            tie="_txn",
            cuts=cuts,
        ).where(F.col("row").isNotNull())

    scanned = by_weight(_base_rows(df, cols, user_events), ["_user"], cuts, run)
    found: dict[str, Column] = {}
    total = {c: F.coalesce(F.col(c), F.lit(0)) for c in totals}
    if "velocity" in families:
        found["txn_velocity_1h"] = total["n_1h"] + 1
        found["txn_velocity_24h"] = total["n_24h"] + 1
    if "amount" in families:
        mean, std = _mean_and_std(total["n_24h"], total["s1"], total["s2"])
        scanned = scanned.withColumns({"_mean": mean, "_std": std})
        found["amount_mean_24h"] = rounded(F.col("_mean"), 6)
        found["amount_std_24h"] = rounded(F.col("_std"), 6)
        found["amount_zscore"] = zscore(F.col("row").getField(cols.amount), F.col("_mean"), F.col("_std"))
    if "merchants" in families:
        found["distinct_merchants_1h"] = total["m_1h"] + F.col("new_1h")
        found["distinct_merchants_24h"] = total["m_24h"] + F.col("new_24h")
    if "last" in families:
        gap = (F.col("position") - F.col("seen.us")) / F.lit(float(US_PER_SECOND))
        known = F.col("seen").isNotNull() & (gap <= history_seconds)
        before, now = F.col("seen.country"), F.col("row").getField(cols.country)
        moved = known & (before != "") & (before != now) & (gap <= travel_seconds)
        travel = F.when(F.coalesce(moved, F.lit(False)), 1).otherwise(0)
        found["impossible_travel_flag"] = travel.cast("bigint")
        found["seconds_since_last_txn"] = F.when(known, rounded(gap, 3)).otherwise(F.lit(-1.0))
    for c in event_totals:
        found[c] = F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return scanned.select("row.*", *[c.alias(name) for name, c in found.items()], *event_lasts)


def snapshot_columns(df: DataFrame) -> DataFrame:
    """The stored snapshot: keys, times and the features in contract order."""
    return df.select("txn_id", "user_id", "txn_timestamp", *FEATURE_COLUMNS)


def snapshot_input(txns: DataFrame) -> DataFrame:
    """What a snapshot needs of a transaction, with the direct signals in place of their inputs."""
    return with_direct_signals(txns).select(
        "txn_id",
        "user_id",
        "txn_timestamp",
        "amount",
        "merchant_id",
        "ip_country",
        "is_foreign_ip",
        "log_amount",
        "is_card_not_present",
        "is_high_risk_category",
    )
