"""Quality rules with thresholds that follow the data of each language and source.

Every document gets integer measures. Per language, source and rule, the measures go into a quantile sketch: counts
per logarithmic bucket (values below 64 exactly, larger ones within 1/32). Sketches merge by adding counts, so those of
a language, and of everything, are sums of the finer ones. Of each sketch come the upper quartile and the mean distance
from the median; both are drawn towards those of the next larger group as ``PRIOR`` documents of it would. A rule rejects
what lies more than its number of such distances above the quartile of its language and source. No threshold is fixed,
and no group is too small for its own.

DataFrame functions only. The document's text is read once and never shuffled by ``measure``; what is shuffled are counts.

Defined results: a null or empty text has no words and fails the base rules; null languages and sources are groups of
their own; repeated rows are judged alike; an empty table gives no rows; other columns are ignored, or kept by ``drop_bad``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerwatch.llm.common import id_key, text_of, unused, words_of
from ledgerwatch.session import persist_table

MIN_WORDS = 50
#: The next larger group counts as this many documents in a group's quartile and distance.
PRIOR = 50
#: Rule -> (value in 1/10,000, distances above the upper quartile that pass).
RULES = {
    "symbol_share": ("10000 * n_symbols div greatest(word_chars, 1)", 3),
    "repeat_share": ("10000 * n_repeat_words div greatest(n_words, 1)", 24),
    "dup_line_share": ("10000 * n_dup_lines div greatest(n_lines, 1)", 48),
    "word_length": ("100 * word_chars div greatest(n_words, 1)", 6),
}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeat_words(words: Column, windows: Column) -> Column:
    """Words within windows found more than once: positions of equal neighbours in the sorted windows, each widened to three."""

    def repeated(x: Column, k: Column) -> Column:
        same = F.get(windows, k - 1)["h"] == x["h"]
        return same | (F.get(windows, k + 1)["h"] == x["h"])

    at = F.transform(F.filter(windows, repeated), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))
    return F.size(F.array_distinct(F.flatten(at))).cast("long")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the base measures and ``n_lines`` as columns, and drops nothing but columns of its own names."""
    body = text_of(text)
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    out = docs.withColumns({"__words": words_of(body), "__lines": lines})
    word = F.col("__words")
    windows = F.when(
        F.size(word) >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size(word) - 3),
            lambda i: F.struct(F.xxhash64(F.get(word, i), F.get(word, i + 1), F.get(word, i + 2)).alias("h"), i.alias("i")),
        ),
    ).otherwise(F.from_json(F.lit("[]"), "array<struct<h:bigint,i:int>>"))
    out = out.withColumn("__windows", F.sort_array(windows))
    return out.withColumns(
        {
            "n_words": F.size(word).cast("long"),
            "word_chars": F.char_length(F.array_join(word, "")).cast("long"),
            "n_symbols": (F.size(F.split(body, r"[#*$%&|<>]", -1)) - 1).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": _repeat_words(word, F.col("__windows")),
        }
    ).drop("__words", "__lines", "__windows")


# -- sketches ----------------------------------------------------------------------------


def bucket_of(value: Column) -> Column:
    """The logarithmic bucket of a whole number from 0: 32 steps per doubling."""
    shift = F.greatest(F.char_length(F.bin(value)) - 6, F.lit(0))
    return (shift * 32 + F.call_function("shiftright", value, shift.cast("int"))).cast("long")


def value_of(bucket: Column) -> Column:
    """The smallest value of a bucket."""
    shift = F.greatest(F.floor(bucket / 32) - 1, F.lit(0)).cast("int")
    return F.call_function("shiftleft", bucket - shift * 32, shift)


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, rule, bucket, n) of the documents that pass the base rules."""
    rule = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.expr(v).alias("value")) for r, (v, _) in RULES.items()]))
    values = measured.where(~F.col("base_failed")).select("lang", "source", rule.alias("_r"))
    values = values.select("lang", "source", "_r.rule", bucket_of(F.col("_r.value")).alias("bucket"))
    return values.groupBy("lang", "source", "rule", "bucket").agg(F.count(F.lit(1)).alias("n"))


def summaries(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Per group of ``keys`` and rule: documents ``n``, upper quartile ``high``, summed distances from the median ``apart``."""
    merged = sketch.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "rule")
    ranked = merged.withColumns({"_upto": F.sum("n").over(group.orderBy("bucket")), "_all": F.sum("n").over(group)})

    def quartile(q: int) -> Column:
        return value_of(F.min(F.when(F.col("_upto") * 4 >= F.col("_all") * q, F.col("bucket"))).over(group))

    ranked = ranked.withColumns({"_middle": quartile(2), "_high": quartile(3)})
    apart = F.sum(F.col("n") * F.abs(value_of(F.col("bucket")) - F.col("_middle")))
    return ranked.groupBy(*keys, "rule").agg(
        F.max("_all").cast("double").alias("n"), F.max("_high").cast("double").alias("high"), apart.cast("double").alias("apart")
    )


def _drawn(own: DataFrame, wider: DataFrame, keys: list[str]) -> DataFrame:
    """``high`` and ``mean`` of the groups of ``own``, drawn towards those of the wider group with the same ``keys``."""
    renamed = wider.select(*[F.col(k).alias(f"_w_{k}") for k in keys], F.col("rule").alias("_w_rule"), F.col("high").alias("_w_high"), F.col("mean").alias("_w_mean"))
    on = F.col("rule") == F.col("_w_rule")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_w_{k}"))
    both = own.join(renamed, on)
    weight = F.col("n") + float(PRIOR)
    high = (F.col("n") * F.col("high") + float(PRIOR) * F.col("_w_high")) / weight
    mean = (F.col("apart") + float(PRIOR) * F.col("_w_mean")) / weight
    return both.withColumns({"high": high, "mean": mean}).select(*own.columns, "mean")


def thresholds(measured: DataFrame) -> DataFrame:
    """One row per (lang, source): the largest value that passes, by rule."""
    sketch = persist_table(sketches(measured), "quality-sketch")
    overall = summaries(sketch, []).withColumn("mean", F.col("apart") / F.col("n"))
    by_lang = _drawn(summaries(sketch, ["lang"]), overall, [])
    fine = _drawn(summaries(sketch, ["lang", "source"]), by_lang, ["lang"])
    times = F.create_map(*[F.lit(x) for r, (_, n) in RULES.items() for x in (r, float(n))])
    fine = fine.withColumn("_most", F.col("high") + times[F.col("rule")] * F.col("mean"))
    return fine.groupBy("lang", "source").agg(*[F.max(F.when(F.col("rule") == r, F.col("_most"))).alias(f"max_{r}") for r in RULES])


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per document: the base measures, ``base_failed`` and ``kept``, with ``text_hash``."""
    plain = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), text_of(text).alias("text")
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    measured = measure(plain).select("doc_id", "lang", "source", F.xxhash64("text").alias("text_hash"), "n_lines", *BASE)
    measured = persist_table(measured.withColumn("base_failed", failed), "quality-measures")
    limits = thresholds(measured).select(
        F.col("lang").alias("_lang"), F.col("source").alias("_source"), *[f"max_{r}" for r in RULES]
    )
    judged = measured.join(
        limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left"
    )
    within = F.lit(True)
    for rule, (value, _) in RULES.items():
        within = within & F.coalesce(F.expr(value) <= F.col(f"max_{rule}"), F.lit(True))
    return judged.select(
        "doc_id", "lang", "source", "text_hash", "n_lines", *BASE, "base_failed", (~F.col("base_failed") & within).alias("kept")
    )


def drop_bad(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents that pass, with the columns they came with. The verdict depends on text, language and source alone."""
    keys = unused(docs, "__doc_id", "__lang", "__source", "__hash")

    def keyed(df: DataFrame, names: list[str], hashed: Column) -> DataFrame:
        return df.withColumns({k: id_key(n) for k, n in zip(keys, names)} | {keys[3]: hashed})

    bad = quality_rules(docs, doc_id, text, lang, source).where("not kept")
    bad = keyed(bad, ["doc_id", "lang", "source"], F.col("text_hash")).select(*keys)
    marked = keyed(docs, [doc_id, lang, source], F.xxhash64(text_of(text)))
    return marked.join(bad, keys, "left_anti").select(*docs.columns)
