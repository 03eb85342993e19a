"""Running totals and last values per key that stay balanced when one key is huge.

A window per key puts all rows of the key into one task. That is right for ordinary keys: one shuffle by key serves
every window. A key with more than a segment's share of rows is cut at quantiles of its own positions into as many
segments as its rows ask for, and each segment starts with one carry row that sums up the segments before it, so the
windows inside the segments give the same answer as one window over the whole key.

A segment's share is ``SEGMENT_ROWS``, or one of ``SHARES`` parts of all rows where that is more: fewer than ``SHARES``
keys can hold more than that, so the table of cuts is small whatever the data, and no large key stays whole. The table
is stored once before the query is planned; data without large keys are planned without segments. Rows of one and the
same position are not parted.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerwatch.session import persist_table

SEGMENT_ROWS = 200_000
SHARES = 10_000
# A key gets the first of these numbers of segments that reaches its rows by the rows of a segment.
_PARTS = (16, 256, 4096)
_BLOCK = 64


def cut_points(rows: DataFrame, keys: list[str], position: str, segment_rows: int = SEGMENT_ROWS) -> DataFrame | None:
    """The keys to cut, with ``_cuts``: the last position of each of their segments but the last.

    Fewer than ``SHARES`` rows, and fewer than ``16 * SHARES`` cuts in all of them together; None where no key is large.
    """
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    parts = F.col("_rows") / F.greatest(F.lit(segment_rows), total / SHARES)
    large = counts.where(F.col("_rows") > segment_rows).select(*keys, parts.alias("_parts")).where("_parts > 1")
    if large.isEmpty():
        return None
    found, at_least = [], 1
    for k, n in enumerate(_PARTS):
        fits = F.col("_parts") > at_least
        if n != _PARTS[-1]:
            fits = fits & (F.col("_parts") <= n)
        shares = [i / n for i in range(1, n)]
        found.append(F.percentile_approx(F.when(fits, F.col(position)), shares, 4 * n).alias(f"_cuts{k}"))
        at_least = n
    own = rows.join(F.broadcast(large), keys).groupBy(*keys).agg(*found)
    cuts = F.array_distinct(F.coalesce(*[F.col(f"_cuts{k}") for k in range(len(_PARTS))]))
    return persist_table(own.select(*keys, cuts.alias("_cuts")).where(F.col("_cuts").isNotNull()), "cuts")


def by_weight(
    df: DataFrame, keys: list[str], cuts: DataFrame | None, run: Callable[[DataFrame, DataFrame | None], DataFrame]
) -> DataFrame:
    """``run(rows, cuts)`` over the rows of ordinary keys, without cuts, and, apart, those of the keys to cut."""
    if cuts is None:
        return run(df, None)
    large = F.broadcast(cuts.select(*keys))
    ordinary = run(df.join(large, keys, "left_anti"), None)
    return ordinary.unionByName(run(df.join(large, keys, "left_semi"), cuts))


def _below(cuts: Column, position: Column) -> Column:
    """How many of up to ``_BLOCK`` ascending cuts lie below the position, by halving; 0 without cuts."""
    steps = F.array(*[F.lit(_BLOCK >> i) for i in range(_BLOCK.bit_length())])
    return F.aggregate(steps, F.lit(0), lambda n, s: F.when(F.get(cuts, n + s - 1) < position, n + s).otherwise(n))


def _with_segment(df: DataFrame, keys: list[str], position: str, cuts: DataFrame) -> DataFrame:
    """Adds ``_seg``, the number of the key's cuts below the position; 0 for a key without cuts.

    A row meets the last cuts of its key's blocks first, and then the cuts of one block, not all cuts of the key.
    """
    starts = F.sequence(F.lit(0), F.size("_cuts") - 1, F.lit(_BLOCK))
    blocks = F.transform(starts, lambda i: F.slice("_cuts", i + 1, F.lit(_BLOCK)))
    blocks = cuts.where(F.size("_cuts") > 0).select(*keys, F.posexplode(blocks).alias("_block", "_near"))
    ends = F.transform(F.sequence(F.lit(_BLOCK), F.size("_cuts"), F.lit(_BLOCK)), lambda i: F.get("_cuts", i - 1))
    ends = cuts.where(F.size("_cuts") >= _BLOCK).select(*keys, ends.alias("_ends"))
    rows = df.join(F.broadcast(ends), keys, "left")
    rows = rows.withColumn("_block", _below(F.col("_ends"), F.col(position))).drop("_ends")
    rows = rows.join(F.broadcast(blocks), [*keys, "_block"], "left")
    seg = F.col("_block") * _BLOCK + _below(F.col("_near"), F.col(position))
    return rows.select(*df.columns, seg.alias("_seg"))


def _all_null(columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNull() for c in columns])


def prefix_scan(
    moves: DataFrame,
    keys: list[str],
    position: str,
    totals: list[str] = (),
    lasts: list[str] = (),
    tie: str | None = None,
    inclusive: bool = False,
    cuts: DataFrame | None = None,
) -> DataFrame:
    """Replace each column of ``totals`` and ``lasts`` by its value over the rows before.

    ``position`` is a bigint. A total is the sum over rows of the same key with a
    smaller position, or a smaller or equal one when ``inclusive``. A last is the
    newest non-null value in the order of ``(position, tie)`` before the row itself.
    With ``cuts`` the keys named there are cut; the result is the same.
    """
    totals, lasts = list(totals), list(lasts)
    order = [F.col(c) for c in [position, tie] if c]
    rows, groups = moves, list(keys)
    if cuts is not None:
        rows, groups = _with_carry(moves, keys, position, totals, lasts, order, cuts), [*keys, "_seg"]

    within = Window.partitionBy(*groups)
    if lasts:
        ordered = within.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumns({c: F.last(c, ignorenulls=True).over(ordered) for c in lasts})
    if totals:
        ranged = within.orderBy(position).rangeBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        rows = rows.withColumns({c: F.sum(c).over(ranged) for c in totals})
    return rows.where(~F.col("_carry")).drop("_seg", "_carry") if cuts is not None else rows


def _with_carry(moves, keys, position, totals, lasts, order, cuts) -> DataFrame:
    """The moves with their ``_seg`` and one carry row ahead of every segment but the first of a key."""
    values = totals + lasts
    at = F.struct(*order)
    aggregates = [F.sum(c).alias(c) for c in totals]
    aggregates += [F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in lasts]
    # Only rows of keys to cut that bring a value: rows that merely ask are pruned from this branch.
    bringing = moves.where(~_all_null(values)).join(F.broadcast(cuts.select(*keys)), keys, "left_semi")
    sums = _with_segment(bringing, keys, position, cuts).groupBy(*keys, "_seg").agg(*aggregates)
    starts = cuts.select(*keys, F.posexplode("_cuts").alias("_seg", position))
    starts = starts.withColumn("_seg", F.col("_seg") + 1)
    both = sums.unionByName(starts, allowMissingColumns=True)
    by_segment = Window.partitionBy(*keys).orderBy("_seg").rangeBetween(Window.unboundedPreceding, -1)
    by_row = Window.partitionBy(*keys).orderBy("_seg", F.col(position).asc_nulls_last())
    by_row = by_row.rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.sum(c).over(by_segment).alias(c) for c in totals]
    # The row of a start stands ahead of the sums of its own segment.
    carried += [F.last(c, ignorenulls=True).over(by_row).alias(c) for c in lasts]
    carry = both.select(*keys, "_seg", position, *carried, F.lit(True).alias("_carry"))
    carry = carry.where(F.col(position).isNotNull() & ~_all_null(values))
    parts = _with_segment(moves, keys, position, cuts)
    return parts.withColumn("_carry", F.lit(False)).unionByName(carry, allowMissingColumns=True)


def neighbours(
    df: DataFrame, keys: list[str], position: str, tie: str, cuts: DataFrame | None = None, cut_keys: list[str] = ()
) -> DataFrame:
    """Adds ``prev_pos`` and ``next_pos``: the nearest strictly smaller and larger position of the key.

    ``next_pos`` is set on the last row of each position only; ``last_at_pos`` tells it.
    With ``cuts`` of ``cut_keys``, part of the keys, segments are fenced by the last position before and the first
    position after them.
    """
    rows, groups = df, list(keys)
    if cuts is not None:
        groups.append("_seg")
        parts = _with_segment(df, list(cut_keys), position, cuts)
        spans = parts.groupBy(*groups).agg(F.min(position).alias("_lo"), F.max(position).alias("_hi"))
        by_segment = Window.partitionBy(*keys).orderBy("_seg")
        spans = spans.select(
            *groups, F.lag("_hi").over(by_segment).alias("_before"), F.lead("_lo").over(by_segment).alias("_after")
        )
        fences = spans.select(
            *groups, F.explode(F.array("_before", "_after")).alias(position), F.lit(True).alias("_fence")
        ).where(F.col(position).isNotNull())
        rows = parts.withColumn("_fence", F.lit(False)).unionByName(fences, allowMissingColumns=True)

    within = Window.partitionBy(*groups)
    following = F.lead(position).over(within.orderBy(position, tie))
    earlier = F.max(position).over(within.orderBy(position).rangeBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"next_pos": following}).withColumns({"prev_pos": earlier})
    last_here = F.col("next_pos").isNull() | (F.col("next_pos") > F.col(position))
    rows = rows.withColumn("last_at_pos", last_here).withColumn("next_pos", F.when(last_here, F.col("next_pos")))
    return rows.where(~F.col("_fence")).drop("_seg", "_fence") if cuts is not None else rows
