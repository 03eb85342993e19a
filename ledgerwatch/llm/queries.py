"""The corpus operators as queries over the given tables, and SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerwatch.llm.alignment import alignment
from ledgerwatch.llm.common import documents
from ledgerwatch.llm.decontamination import WINDOW, overlaps
from ledgerwatch.llm.exact_dedup import exact_dedup
from ledgerwatch.llm.hard_negatives import LOWER, NEGATIVES, POSITIVES, SCALE, hard_negatives
from ledgerwatch.llm.license_scan import license_scan, registered_templates
from ledgerwatch.llm.line_dedup import line_dedup
from ledgerwatch.llm.mixing import MAX_EPOCHS, SEED, mix
from ledgerwatch.llm.packing import pack
from ledgerwatch.llm.pipeline import run as pipeline
from ledgerwatch.llm.quality_classifier import classify
from ledgerwatch.llm.quality_rules import MIN_WORDS, PRIOR, RULES as QUALITY, quality_rules
from ledgerwatch.llm.secret_scan import BASE as BASE_SECRETS, RULES as SECRETS, secret_scan
from ledgerwatch.llm.simhash import near_dedup
from ledgerwatch.llm.token_counts import token_counts

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _sha(text: Column) -> Column:
    return F.sha2(text, 256)


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = line_dedup(documents(spark, folder))
    return rows.select("doc_id", "n_lines", "n_dropped", _sha(F.col("kept_text")).alias("kept_sha256"))


def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(documents(spark, folder), vocabulary())


def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return classify(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(documents(spark, folder), vocabulary())


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix(documents(spark, folder)).select("doc_id", "size", "source_size", "target", "taken")


def op6_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan(documents(spark, folder), registered_templates(spark))


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup(documents(spark, folder))


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality_rules(documents(spark, folder))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = exact_dedup(documents(spark, folder))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    rows = secret_scan(documents(spark, folder))
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", _sha(F.col("base_spans")).alias("base_sha256"), "spans")


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/embeddings.parquet")
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(rows, F.col("vec_id") % 100 == 0, moved)


def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment(documents(spark, folder), vocabulary(), pieces())


def op13_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    rows = overlaps(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        _sha(F.array_join("items", ",")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def queries() -> dict[str, Query]:
    named = [
        op1_line_dedup,
        op2_best_fit_packing,
        op3_quality_classifier,
        op4_token_counts,
        op5_mixing,
        op6_license_scan,
        op7_simhash,
        op8_quality_rules,
        op9_exact_dedup,
        op10_secret_scan,
        op11_hard_negatives,
        op12_alignment,
        op13_decontamination,
    ]
    return {f.__name__: f for f in named} | {"pipeline": pipeline}


# -- SQL ---------------------------------------------------------------------------------

_BLANK = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, {_BLANK}), {_UPPER}, lower({_UPPER})) AS key FROM lines
), often AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.*, o.key IS NOT NULL AND k.doc_id <> o.keeper AS lost FROM keyed k LEFT JOIN often o USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP5 = f"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         1 + (row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) - 1) % 3 AS weight
  FROM sizes GROUP BY source
), ordered AS (
  SELECT *, {MAX_EPOCHS} * source_size AS cap, sum(source_size) OVER () AS total,
         coalesce(sum({MAX_EPOCHS} * source_size) OVER below, 0) AS caps_below,
         sum(weight) OVER upward AS weights_from
  FROM sources
  WINDOW below AS (ORDER BY {MAX_EPOCHS} * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         upward AS (ORDER BY {MAX_EPOCHS} * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), flagged AS (
  SELECT *, cap * weights_from < weight * (total - caps_below) AS over FROM ordered
), level AS (
  SELECT CAST(any_value(total) - coalesce(sum(cap) FILTER (WHERE over), 0) AS DOUBLE) AS words,
         CAST(sum(weight) FILTER (WHERE NOT over) AS DOUBLE) AS weights
  FROM flagged
), targets AS (
  SELECT source, source_size, CASE WHEN over THEN CAST(cap AS DOUBLE) ELSE weight * words / weights END AS target
  FROM flagged, level
), whole AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS times FROM targets
), cumulated AS (
  SELECT s.doc_id, s.size, w.source_size, w.target, w.times,
         CAST(round(w.target) AS BIGINT) - w.times * w.source_size
           - coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5('{SEED}:' || coalesce(CAST(s.doc_id AS VARCHAR), '')), s.doc_id
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
  FROM sizes s JOIN whole w ON s.source IS NOT DISTINCT FROM w.source
)
SELECT doc_id, size, source_size, target, CAST(times * size + least(greatest(room, 0), size) AS BIGINT) AS taken FROM cumulated
"""


def _op8() -> str:
    bits = "length(bin(value)) - 6"
    bucket = f"greatest({bits}, 0) * 32 + (value >> greatest({bits}, 0))"
    least = "bucket - greatest(bucket // 32 - 1, 0) * 32 << greatest(bucket // 32 - 1, 0)"
    values = " UNION ALL ".join(
        f"SELECT doc_id, lang, source, '{r}' AS rule, CAST({v.replace(' div ', ' // ')} AS BIGINT) AS value, {n}e0 AS times FROM judged WHERE NOT base_failed"
        for r, (v, n) in QUALITY.items()
    )

    def summary(name: str, keys: str) -> str:
        group = f"{keys}rule"
        return f"""{name}_ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY {group} ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {group}) AS every, {least} AS low
  FROM (SELECT {group}, bucket, count(*) AS n FROM bucketed GROUP BY {group}, bucket)
), {name}_marks AS (
  SELECT {group}, min(CASE WHEN upto * 4 >= every * 2 THEN low END) AS middle, min(CASE WHEN upto * 4 >= every * 3 THEN low END) AS high
  FROM {name}_ranked GROUP BY {group}
), {name}_own AS (
  SELECT {', '.join(f'r.{k}' for k in group.split(', '))}, CAST(any_value(every) AS DOUBLE) AS n, CAST(any_value(high) AS DOUBLE) AS high,
         CAST(sum(r.n * abs(low - middle)) AS DOUBLE) AS apart
  FROM {name}_ranked r JOIN {name}_marks m ON {' AND '.join(f'r.{k} IS NOT DISTINCT FROM m.{k}' for k in group.split(', '))}
  GROUP BY {', '.join(f'r.{k}' for k in group.split(', '))}
)"""

    def drawn(name: str, wider: str, keys: list[str]) -> str:
        on = " AND ".join(f"o.{k} IS NOT DISTINCT FROM w.{k}" for k in [*keys, "rule"])
        return f"""{name} AS (
  SELECT o.* REPLACE ((o.n * o.high + {PRIOR}e0 * w.high) / (o.n + {PRIOR}e0) AS high), (o.apart + {PRIOR}e0 * w.mean) / (o.n + {PRIOR}e0) AS mean
  FROM {name}_own o JOIN {wider} w ON {on}
)"""

    return f"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text, {_WORDS} AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents
), positions AS (
  SELECT r, unnest(range(1, len(words) - 1)) AS i, words FROM texts
), windows AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, words[i], words[i + 1], words[i + 2]) AS found FROM positions
), repeated AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE found > 1) GROUP BY r
), base AS (
  SELECT doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM texts LEFT JOIN repeated USING (r)
), judged AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base
), valued AS (
  {values}
), bucketed AS (
  SELECT *, {bucket} AS bucket FROM valued
), {summary('fine', 'lang, source, ')}, {summary('by_lang', 'lang, ')}, {summary('overall', '')}, overall AS (
  SELECT *, apart / n AS mean FROM overall_own
), {drawn('by_lang', 'overall', [])}, {drawn('fine', 'by_lang', ['lang'])}, verdicts AS (
  SELECT b.doc_id, bool_and(b.value <= f.high + b.times * f.mean) AS within
  FROM bucketed b
  JOIN fine f ON b.lang IS NOT DISTINCT FROM f.lang AND b.source IS NOT DISTINCT FROM f.source AND b.rule = f.rule
  GROUP BY b.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND within AS kept
FROM (SELECT j.*, coalesce(within, false) AS within FROM judged j LEFT JOIN verdicts v USING (doc_id))
"""


OP9 = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def _op10() -> str:
    parts = []
    for no, (kind, pattern, group, size, _) in enumerate(SECRETS):
        quoted = pattern.replace("'", "''")
        parts.append(
            f"""SELECT doc_id, {no} AS kind_no, '{kind}' AS kind, {size} AS least,
       list_transform(string_split_regex(body, '{quoted}'), lambda x: length(x)) AS gaps,
       list_transform(regexp_extract_all(body, '{quoted}', 0), lambda x: length(x)) AS sizes,
       list_transform(regexp_extract_all(body, '{quoted}', {group}), lambda x: length(x)) AS vals
FROM texts"""
        )
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in BASE_SECRETS)
    text = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_no, stop)"
    return f"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS body FROM documents
), matches AS (
  {' UNION ALL '.join(parts)}
), placed AS (
  SELECT doc_id, kind_no, kind, least, sizes[i] AS size, vals[i] AS val, list_sum(gaps[1:i]) + coalesce(list_sum(sizes[1:i - 1]), 0) AS start
  FROM (SELECT *, unnest(range(1, len(sizes) + 1)) AS i FROM matches)
), spans AS (
  SELECT doc_id, kind_no, kind, CAST(start AS BIGINT) AS start, CAST(start + size AS BIGINT) AS stop FROM placed WHERE val >= least
), found AS (
  SELECT doc_id, {counts}, {text} AS spans, {text} FILTER (WHERE kind IN {BASE_SECRETS}) AS base_spans
  FROM spans GROUP BY doc_id
)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in BASE_SECRETS)},
       sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN found USING (doc_id)
"""


OP11 = f"""
WITH fit AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM fit a JOIN fit r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}
)
SELECT anchor_id, positive_id, CAST(row_number() OVER pair AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM positives p JOIN scores s USING (anchor_id)
WHERE NOT s.same AND 100 * s.score BETWEEN {LOWER} * positive_score AND 100 * positive_score
WINDOW pair AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER pair <= {NEGATIVES}
"""

_PLAIN_WORDS = (
    f"regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, lower({_UPPER})),"
    r" '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

OP13 = f"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, {_PLAIN_WORDS} AS words FROM documents
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, {_PLAIN_WORDS} AS words FROM benchmark
), windows AS (
  SELECT DISTINCT item, least(len(words), {WINDOW}) AS size, array_to_string(words[i:i + least(len(words), {WINDOW}) - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, greatest(len(words) - {WINDOW} + 1, 1) + 1)) AS i FROM items WHERE len(words) > 0)
), places AS (
  SELECT r, size, i, array_to_string(words[i:i + size - 1], ' ') AS phrase
  FROM (SELECT r, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM texts, (SELECT DISTINCT size FROM windows))
), found AS (
  SELECT r, i, size, item FROM places JOIN windows USING (size, phrase)
), hit AS (
  SELECT r, count(DISTINCT word) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS word FROM found) GROUP BY r
), named AS (
  SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM found GROUP BY r
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM texts LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": OP1,
        "op5_mixing": OP5,
        "op8_quality_rules": _op8(),
        "op9_exact_dedup": OP9,
        "op10_secret_scan": _op10(),
        "op11_hard_negatives": OP11,
        "op13_decontamination": OP13,
    }
