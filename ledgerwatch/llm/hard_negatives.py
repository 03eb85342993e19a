"""Hard negatives of anchor vectors by slot-decomposed selection.

A positive with score p looks for negatives with scores from ``LOWER`` percent of p up to p. The distinct upper limits of
an anchor's positives, from the highest down, split the scores into disjoint slots: slot j holds what lies at or below
limit j and above limit j + 1. Every negative belongs to one slot, so one pass over the rows serves all windows: each
block of rows keeps the best k of each slot, a combined top-k keeps the best k over all blocks, and merging the slots from
the lowest upwards gives for every limit the best k at or below it. A window is such a list without what lies below its
lower limit.

Anchors meet rows in blocks of bounded size, each pair of blocks in one group, so that neither side is broadcast or
collected and no label can make a group large. What leaves a group is at most k rows per anchor and slot.

Components are scaled by ``SCALE`` and floored, and scores are integers, exact at any size of the components; a scaled
component outside 64 bits counts as the nearest 64-bit number, and a score beyond 2^56 in size as 2^56 with its sign.

Defined results: a row with a null id, a null label, a null vector, or a null or non-finite component takes no part; rows
with the same id count as one, the one with the smallest label and then the smallest vector; components that the shorter
of two vectors lacks count as zero, so an empty vector scores zero; ties go to the smaller id; an anchor without positives,
and a positive without negatives in its window, give no rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerwatch.llm.common import shard_count
from ledgerwatch.session import persist_table

POSITIVES = 5
NEGATIVES = 5
#: A negative's score is at least this percentage of its positive's.
LOWER = 80
SCALE = 256
#: Rows and anchors of one group at most; fewer where that occupies more cores.
ROWS = 65_536
ANCHORS = 16_384
_SCORES_AT_ONCE = 2_000_000
_LARGEST = 1 << 56


# -- scores within a group ---------------------------------------------------------------


def _matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = vectors.combine_chunks()
    sizes = flat.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = flat.flatten().to_numpy()
    return out


def _width(*tables: pa.Table) -> int:
    return max((int(t.column("vector").combine_chunks().value_lengths().to_numpy(zero_copy_only=False).max()) for t in tables), default=0)


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products, exact, clamped to ``_LARGEST``."""
    def size(x: np.ndarray) -> int:
        return max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))

    bound = anchors.shape[1] * size(anchors) * size(rows)
    if bound < 1 << 53:
        return (anchors.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
    if bound < 1 << 63:
        return np.clip(anchors @ rows.T, -_LARGEST, _LARGEST)
    exact = anchors.astype(object) @ rows.T.astype(object)
    return np.clip(exact, -_LARGEST, _LARGEST).astype(np.int64)


def _each_anchor(rows: pa.Table, anchors: pa.Table):
    """Yields for every anchor its number, its scores with all rows, and which rows have its label."""
    width = _width(rows, anchors)
    table, queries = _matrix(rows.column("vector"), width), _matrix(anchors.column("vector"), width)
    labels, wanted = rows.column("label").to_numpy(), anchors.column("label").to_numpy()
    step = max(1, _SCORES_AT_ONCE // max(1, len(table)))
    for first in range(0, len(queries), step):
        scores = _scores(queries[first : first + step], table)
        for k, line in enumerate(scores, first):
            yield k, line, labels == wanted[k]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: higher scores first, then smaller ids."""
    among = np.arange(len(scores))
    if len(scores) > k:
        among = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return among[np.lexsort((ids[among], -scores[among]))[:k]]


def _same_label(k: int):
    def find(key, rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = {"anchor_id": [], "positive_id": [], "positive_score": []}
        if rows.num_rows and anchors.num_rows:
            ids, of = rows.column("vec_id").to_numpy(), anchors.column("vec_id").to_numpy()
            for i, scores, same in _each_anchor(rows, anchors):
                among = np.flatnonzero(same & (ids != of[i]))
                among = among[_best(scores[among], ids[among], k)]
                out["anchor_id"].append(np.full(len(among), of[i]))
                out["positive_id"].append(ids[among])
                out["positive_score"].append(scores[among])
        return _table(out)

    return find


def _other_label(k: int, lower: int):
    def find(key, rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = {"anchor_id": [], "slot": [], "down": [], "negative_id": []}
        if rows.num_rows and anchors.num_rows:
            ids, of = rows.column("vec_id").to_numpy(), anchors.column("vec_id").to_numpy()
            limits = anchors.column("limits").to_pylist()
            for i, scores, same in _each_anchor(rows, anchors):
                upper = np.array(limits[i], dtype=np.int64)
                among = np.flatnonzero(~same & (scores <= upper[0]))
                # The last limit that is not below the score; what lies below all windows of its slot goes at once.
                slot = len(upper) - 1 - np.searchsorted(upper[::-1], scores[among])
                inside = 100 * scores[among] >= lower * upper[slot]
                among, slot = among[inside], slot[inside]
                order = np.lexsort((ids[among], -scores[among]))
                among, slot = among[order], slot[order]
                among, slot = (x[np.arange(len(slot)) - np.searchsorted(slot, slot) < k] for x in (among, slot))
                out["anchor_id"].append(np.full(len(among), of[i]))
                out["slot"].append(slot)
                out["down"].append(-scores[among])
                out["negative_id"].append(ids[among])
        return _table(out)

    return find


def _table(columns: dict) -> pa.Table:
    return pa.table({c: pa.array(np.concatenate(x or [np.zeros(0)]).astype(np.int64)) for c, x in columns.items()})


# -- the whole ---------------------------------------------------------------------------


def scaled_rows(rows: DataFrame, vec_id: str, vector: str, label: Column, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part, one per id, the vectors as integers."""
    parts = F.col(vector).cast("array<double>")
    finite = F.forall(parts, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    plain = rows.select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), parts.alias("parts"))
    fit = plain.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    whole = F.transform("parts", lambda x: F.floor(x * scale).cast("long"))
    least = fit.groupBy("vec_id").agg(F.min(F.struct("label", whole.alias("vector"))).alias("row"))
    return least.select("vec_id", "row.label", "row.vector")


def _meet(rows: DataFrame, anchors: DataFrame, row_blocks: int, anchor_blocks: int, find, schema: str) -> DataFrame:
    """Brings every block of rows together with every block of anchors."""
    def block(salt: str, blocks: int) -> Column:
        return F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(blocks)).cast("int")

    def all_of(blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    keys = ["row_block", "anchor_block"]
    left = rows.withColumn("row_block", block("row", row_blocks)).withColumn("anchor_block", all_of(anchor_blocks))
    # Both sides come from one table: aliases keep their columns apart.
    anchors = anchors.select(*[F.col(c).alias(c) for c in anchors.columns])
    right = anchors.withColumn("anchor_block", block("anchor", anchor_blocks)).withColumn("row_block", all_of(row_blocks))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(find, schema)


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    label: Column | None = None,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    lower: int = LOWER,
    scale: int = SCALE,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """One row per anchor, positive and negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on ``vec_id`` alone; ``label`` an expression over ``rows``, the column of that name if
    not given.
    """
    spark = rows.sparkSession
    label = F.col("label") if label is None else label
    table = persist_table(scaled_rows(rows, vec_id, vector, label, scale), "vectors")
    anchors = table.where(is_anchor)
    n, m = table.agg(F.count(F.lit(1)), F.count_if(is_anchor)).first()
    busy = 2 * spark.sparkContext.defaultParallelism
    row_blocks = max(shard_count(n, ROWS), min(shard_count(n, 1024), busy))
    blocks = (row_blocks, shard_count(m, ANCHORS))

    near = _meet(table, anchors, *blocks, _same_label(positives), "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    chosen = near.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= positives).drop("nth")
    chosen = persist_table(chosen, "positives")
    # At most as many limits as positives.
    limits = chosen.groupBy("anchor_id").agg(F.sort_array(F.collect_set("positive_score"), asc=False).alias("limits"))

    asking = anchors.join(limits, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id")
    found = _meet(table, asking, *blocks, _other_label(negatives, lower), "anchor_id long, slot long, down long, negative_id long")
    order = Window.partitionBy("anchor_id", "slot").orderBy("down", "negative_id")
    kept = found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= negatives)
    slots = kept.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("slot", "down", "negative_id"))).alias("kept"))
    return _windows(chosen, limits, slots, negatives, lower)


def _windows(chosen: DataFrame, limits: DataFrame, slots: DataFrame, k: int, lower: int) -> DataFrame:
    """Merges the slots from the lowest limit upwards; the list of a limit serves all positives with that score."""
    kind = "array<struct<slot:bigint,down:bigint,negative_id:bigint>>"
    start = F.expr(f"named_struct('best', cast(array() AS {kind}), 'lists', cast(array() AS array<{kind}>))")

    def merge(done: Column, slot: Column) -> Column:
        own = F.filter("kept", lambda x: x["slot"] == slot)
        best = F.slice(F.concat(own, done["best"]), 1, k)
        return F.struct(best.alias("best"), F.concat(F.array(best), done["lists"]).alias("lists"))

    upwards = F.reverse(F.sequence(F.lit(0).cast("long"), F.size("limits").cast("long") - 1))
    merged = limits.join(slots, "anchor_id").withColumn("lists", F.aggregate(upwards, start, merge)["lists"])
    both = chosen.join(merged.select("anchor_id", "limits", "lists"), "anchor_id")
    reach = F.element_at("lists", F.array_position("limits", F.col("positive_score")).cast("int"))
    inside = F.filter(reach, lambda x: -100 * x["down"] >= lower * F.col("positive_score"))
    rows = both.select("anchor_id", "positive_id", "positive_score", F.posexplode(inside).alias("nth", "found"))
    return rows.select(
        "anchor_id",
        "positive_id",
        (F.col("nth") + 1).alias("rank"),
        F.col("found.negative_id").alias("negative_id"),
        "positive_score",
        (-F.col("found.down")).alias("negative_score"),
    )
