"""Secret scans with an incremental ledger of contents.

Every version of every document is a blob named by the SHA-256 of its text. The ledger says which blobs were scanned
by which rules, each with a version of its own, and what was found in them. A scan looks up the blobs of its documents,
reads the text of one document per blob that some rule has not seen, runs these rules alone, adds the findings to the
ledger, and joins them back to all documents that hold the blob, in whatever version or place. ``secret_scan`` scans the
documents in two parts with one ledger, so that blobs of the first part are not read again in the second.

DataFrame functions only. Spans are found from the lengths of the matches and of what lies between them, in code points.
All that is shuffled besides the texts to scan are digests, ids and spans.

Defined results: a null text counts as empty; repeated rows and ids get their findings each; an empty table gives no rows;
matches within one kind do not overlap, those of different kinds may; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerwatch.llm.common import id_key, text_of
from ledgerwatch.session import persist_table

# Fixed values: (kind, pattern, group whose length counts, least length, version), in the order of the kinds. A changed
# pattern gets the next version: blobs are scanned again by that rule, and by no other.
RULES = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, 1),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18, 1),
    ("hex", r"[0-9a-f]{16,}", 0, 16, 1),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}", 0, 1, 1),
    ("hosted", r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{16,}", 0, 1, 1),
    ("url", r"[a-z][a-z0-9+.-]{1,20}://[^\x20\x09-\x0D/:@]{1,64}:[^\x20\x09-\x0D/:@]{3,64}@", 0, 1, 1),
]
#: The kinds of the contract.
BASE = ("assign", "access", "hex")


def _tag(rule: tuple) -> str:
    return f"{rule[0]}@{rule[4]}"


@dataclass(frozen=True)
class Ledger:
    """``scanned``: (blob, rules), the rules as an array of ``kind@version``. ``findings``: (blob, rule, kind, kind_no, start, end)."""

    scanned: DataFrame
    findings: DataFrame


def blob_of(text: str = "text") -> Column:
    return F.sha2(text_of(text), 256)


def _matches(no: int, kind: str, pattern: str, group: int) -> Column:
    """The kind's matches in ``text``: length of what lies before each, its own, and that of the group."""

    def lengths(c: Column) -> Column:
        return F.transform(c, F.char_length)

    text, regex = F.col("text"), F.lit(pattern)
    parts = F.arrays_zip(
        lengths(F.split(text, pattern, -1)).alias("gap"),
        lengths(F.regexp_extract_all(text, regex, F.lit(0))).alias("size"),
        lengths(F.regexp_extract_all(text, regex, F.lit(group))).alias("value"),
    )
    named = F.transform(
        parts, lambda p, i: F.struct(F.lit(no).alias("kind_no"), F.lit(kind).alias("kind"), i.alias("nth"), p["gap"].alias("gap"), p["size"].alias("size"), p["value"].alias("value"))
    )
    return F.when(text.rlike(pattern), named)


def find(blobs: DataFrame) -> DataFrame:
    """(blob, rule, kind, kind_no, start, end) of the matches in rows (blob, text, todo); a blob in several rows counts once.

    ``todo`` has the tags of the rules to run.
    """
    empty = F.lit(None).cast("array<struct<kind_no:int,kind:string,nth:int,gap:int,size:int,value:int>>")
    found = []
    for no, rule in enumerate(RULES):
        asked = F.when(F.array_contains("todo", _tag(rule)), _matches(no, *rule[:3]))
        found.append(F.coalesce(asked, empty, F.array()))
    rows = blobs.select("blob", F.explode(F.concat(*found)).alias("m")).select("blob", "m.*").where("size is not null")
    # Rows of one blob have equal matches. Without this the sums below would add up those of all its rows.
    rows = rows.distinct()
    upto = Window.partitionBy("blob", "kind_no").orderBy("nth")
    end = F.sum(F.col("gap") + F.col("size")).over(upto)
    least = F.create_map(*[F.lit(x) for kind, _, _, size, _ in RULES for x in (kind, size)])
    tags = F.create_map(*[F.lit(x) for rule in RULES for x in (rule[0], _tag(rule))])
    rows = rows.withColumn("end", end).where(F.col("value") >= least[F.col("kind")])
    return rows.select("blob", tags[F.col("kind")].alias("rule"), "kind", "kind_no", (F.col("end") - F.col("size")).alias("start"), "end")


def unseen_blobs(paths: DataFrame, ledger: Ledger | None) -> DataFrame:
    """(blob, id, todo): the blobs that some rule has not seen, with the id of a document that holds each."""
    current = F.array(*[F.lit(_tag(r)) for r in RULES])
    blobs = paths.groupBy("blob").agg(F.min("id").alias("id"))
    if ledger is None:
        return blobs.withColumn("todo", current)
    seen = ledger.scanned.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
    todo = F.when(F.col("seen").isNull(), current).otherwise(F.array_except(current, "seen"))
    return blobs.join(seen, "blob", "left").select("blob", "id", todo.alias("todo")).where(F.size("todo") > 0)


def scan(docs: DataFrame, ledger: Ledger | None = None, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, Ledger]:
    """(doc_id, blob) of the documents, and the ledger after their unseen blobs were scanned."""
    paths = docs.select(F.col(doc_id).alias("doc_id"), id_key(doc_id).alias("id"), blob_of(text).alias("blob"))
    paths = persist_table(paths, "blob-paths")
    unseen = persist_table(unseen_blobs(paths, ledger), "unseen-blobs")
    # One id per blob: documents find their text by hash, without sorting texts. Rows repeated with id and text all pass.
    texts = docs.select(id_key(doc_id).alias("id"), blob_of(text).alias("blob"), text_of(text).alias("text"))
    found = find(texts.join(unseen.hint("shuffle_hash"), ["id", "blob"]))
    scanned = unseen.select("blob", F.col("todo").alias("rules"))
    if ledger is not None:
        found, scanned = ledger.findings.unionByName(found), ledger.scanned.unionByName(scanned)
    return paths, Ledger(persist_table(scanned, "scanned-blobs"), persist_table(found, "blob-findings"))


def report(paths: DataFrame, ledger: Ledger) -> DataFrame:
    """One row per document: doc_id, matches per kind, all spans as ``kind:start:end`` by start and kind, and those of the base kinds."""
    current = ledger.findings.where(F.col("rule").isin([_tag(r) for r in RULES]))
    spans = F.sort_array(F.collect_list(F.struct("start", "kind_no", "end", "kind")))

    def named(of: Column) -> Column:
        return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    kinds = [r[0] for r in RULES]
    per_blob = current.groupBy("blob").agg(spans.alias("_all"), *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in kinds])
    base = F.filter("_all", lambda s: s["kind"].isin(*BASE))
    per_blob = per_blob.withColumns({"spans": named(F.col("_all")), "base_spans": named(base)}).drop("_all")
    # Stored first, so that the join is free to split a blob that very many documents hold.
    per_blob = persist_table(per_blob, "blob-spans")
    counts = [F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in kinds]
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("spans", "base_spans")]
    return paths.join(per_blob, "blob", "left").select("doc_id", *counts, *texts)


def secret_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The report on documents that no ledger knows yet, which come in two parts by a hash of their ids."""
    later = F.pmod(F.xxhash64(id_key(doc_id), F.lit("part")), F.lit(2)) == 1
    first, ledger = scan(docs.where(~later), None, doc_id, text)
    second, ledger = scan(docs.where(later), ledger, doc_id, text)
    return report(first.unionByName(second), ledger)
