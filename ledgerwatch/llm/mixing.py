"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

The words of all sources are shared out by weight. A source whose share is more than ``max_epochs`` times its own words
is clamped there, and what is over is shared among the others by weight, until no share is too large. A source is then
taken whole as often as its target holds it, and the rest of the target is filled with documents in the order of a
seeded hash; the last of them is taken in part, so that the words taken equal the target.

DataFrame functions only. The order within a source is kept by parts of the hash's range with a few thousand documents
each, so a source may hold any share of all rows.

Defined results: a null text has no words; a null source is a source of its own and the last in order; repeated rows are
documents of their own; a source without words has target 0; an empty table gives no rows; other columns are ignored, or
kept by ``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerwatch.llm.common import id_key, text_of, unused, words_of
from ledgerwatch.session import persist_table

MAX_EPOCHS = 3
SEED = 42
WEIGHTS = (1, 2, 3)
DOCS_PER_PART = 4096
_HASH_RANGE = 1 << 24


def ranked(df: DataFrame, column: str) -> DataFrame:
    """Adds ``rank`` from 0 in ascending order of ``column``, null last, without one task that sees all rows."""
    ordered = df.orderBy(F.col(column).asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id())
    ordered = persist_table(ordered, "ordered").withColumns(
        {"_part": F.shiftright("_at", 33), "_nth": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}
    )
    # One row per sorted partition.
    parts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return ordered.join(parts, "_part").withColumn("rank", F.col("_before") + F.col("_nth")).drop("_at", "_part", "_nth", "_before")


def repeating_weights(sources: DataFrame) -> DataFrame:
    """Adds ``weight``: 1, 2, 3, repeating, by code point of the source, null last."""
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    return ranked(sources, "source").withColumn("weight", F.get(weights, (F.col("rank") % len(WEIGHTS)).cast("int"))).drop("rank")


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds ``target`` to sources with ``source_size`` and ``weight``. Only sums over all sources go to the driver."""
    cap = F.col("source_size") * max_epochs

    def above(words: int, weights: int) -> Column:
        def whole(x) -> Column:
            return (x if isinstance(x, Column) else F.lit(x)).cast("decimal(19,0)")

        return whole(cap) * whole(weights) < whole(F.col("weight")) * whole(words)

    level: tuple[int, int] | None = None
    capped = -1
    while True:
        # The level is a fraction: words that are left over the weights that share them.
        over = F.lit(False) if level is None else above(*level)
        row = sources.agg(
            F.sum("source_size"), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight"))), F.count(F.when(over, 1))
        ).first()
        total, held, weights, now = (int(x or 0) for x in row)
        if now == capped or not weights:
            break
        level, capped = (total - held, weights), now
    words, weights = level or (0, 1)
    share = F.col("weight") * F.lit(float(words)) / F.lit(float(weights))
    return sources.withColumn("target", F.when(above(words, weights), cap.cast("double")).otherwise(share))


def sizes_of(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """Equal rows are one item with their number."""
    body = text_of(text)
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        F.xxhash64(body).alias("text_hash"),
        F.size(words_of(body)).cast("long").alias("size"),
    )
    return rows.groupBy("doc_id", "source", "text_hash", "size").agg(F.count(F.lit(1)).alias("copies"))


def _order(doc_id: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))


def shares(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    weigh=repeating_weights,
) -> DataFrame:
    """One row per item of ``sizes_of`` with its source's size and target, whole repetitions, and further words taken (``extra``)."""
    items = persist_table(sizes_of(docs, doc_id, text, source), "sizes").withColumns(
        {"_key": id_key("source"), "_hash": _order("doc_id", seed)}
    )
    sources = items.groupBy("source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count(F.lit(1)).alias("_items")
    )
    sources = persist_table(water_fill(persist_table(weigh(sources), "weights"), max_epochs), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.greatest(F.round("target").cast("long") - F.col("_whole") * F.col("source_size"), F.lit(0))
    facts = sources.withColumn("_whole", whole.cast("long")).select(
        id_key("source").alias("_key"), "source_size", "target", "_whole", rest.alias("_rest"), F.ceil(F.col("_items") / DOCS_PER_PART).alias("_parts")
    )
    place = F.conv(F.substring("_hash", 1, 6), 16, 10).cast("long")
    rows = items.join(facts, "_key").withColumn("_part", F.floor(place * F.col("_parts") / _HASH_RANGE).cast("long"))
    words = F.col("size") * F.col("copies")
    ahead = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("_key", "_part").agg(F.sum(words).alias("_words"))
    parts = parts.select("_key", "_part", F.coalesce(F.sum("_words").over(ahead), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_key", "_part").orderBy("_hash", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_within", F.coalesce(F.sum(words).over(within), F.lit(0))).join(parts, ["_key", "_part"])
    extra = F.least(F.greatest(F.col("_rest") - F.col("_before") - F.col("_within"), F.lit(0)), words)
    return rows.select(
        "doc_id", "source", "text_hash", "size", "copies", "source_size", "target", F.col("_whole").alias("whole"), extra.alias("extra")
    )


def _part(copy: str, extra: str, size: str) -> Column:
    """Of the further words of equal rows, those that one of them takes."""
    return F.least(F.greatest(F.col(extra) - (F.col(copy) - 1) * F.col(size), F.lit(0)), F.col(size))


def mix(docs: DataFrame, *args, **options) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, whole repetitions, words of a further one, words taken."""
    rows = shares(docs, *args, **options).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    rows = rows.withColumn("part", _part("copy", "extra", "size"))
    taken = F.col("whole") * F.col("size") + F.col("part")
    return rows.select("doc_id", "source", "size", "source_size", "target", "whole", "part", taken.alias("taken"))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix as documents, with the columns they came with: a row per repetition, the last one cut to the words it takes."""
    names = unused(docs, "__id", "__source", "__hash", "__size", "__whole", "__extra", "__copy", "__part", "__time")
    row, of, hashed, size, whole_times, extra, nth, part, time = names
    keys = [row, of, hashed]
    chosen = shares(docs, doc_id, text, source, **options)
    chosen = chosen.select(
        id_key("doc_id").alias(row),
        id_key("source").alias(of),
        F.col("text_hash").alias(hashed),
        *[F.col(c).alias(n) for c, n in (("size", size), ("whole", whole_times), ("extra", extra))],
    )
    body = text_of(text)
    marked = docs.withColumns({row: id_key(doc_id), of: id_key(source), hashed: F.xxhash64(body)}).join(chosen, keys)
    copy = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0))).cast("long")
    marked = marked.withColumn(nth, copy).withColumn(part, _part(nth, extra, size))
    whole = F.col(whole_times) + F.when((F.col(part) == F.col(size)) & (F.col(size) > 0), 1).otherwise(0)
    cut = (F.col(part) > 0) & (F.col(part) < F.col(size))
    none = F.array().cast("array<bigint>")
    # 0 marks the repetition that is cut.
    times = F.concat(
        F.when(whole > 0, F.sequence(F.lit(1).cast("long"), whole)).otherwise(none),
        F.when(cut, F.array(F.lit(0).cast("long"))).otherwise(none),
    )
    rows = marked.withColumn(time, F.explode(times))
    head = F.array_join(F.slice(words_of(body), F.lit(1), F.col(part).cast("int")), " ")
    return rows.withColumn(text, F.when(F.col(time) == 0, head).otherwise(F.col(text))).select(*docs.columns)
