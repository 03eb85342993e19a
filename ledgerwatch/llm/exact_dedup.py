"""Exact dedup: a minimal perfect hash over the distinct digests seen so far.

Documents come in parts. The first part is indexed; each later one is looked up: digests that are members add to their
entry, the others are grouped by themselves and become entries, and the index is built anew over all of them, to be stored
for the next part. Rows learn from the last index which row stays.

Per shard of digests, levels of bit arrays give each known digest a slot of its own: a digest sets a bit of the
first level at which no other digest wants the same bit, and its slot is the number of bits set before it. The
slots hold whole digests, so a lookup compares bytes and never takes a stranger for a member, and the locator of
the row that stays.

Nothing but digests and ids is shuffled. Copies spread over the groups of ``common.lookup``, however many there are.

Defined results: a null text equals an empty one; a null id is smaller than any other; of repeated rows (same id,
same text) one stays; an empty table gives no rows; other columns are ignored, or kept as they are by ``drop_copies``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerwatch.llm.common import id_key, lookup, shard_count, shard_of, text_of, unused
from ledgerwatch.session import persist_table

DIGEST_BYTES = 32
KEYS_PER_SHARD = 40_000
_LEVELS = 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


def digest_of(text: str = "text") -> Column:
    return F.unhex(F.sha2(text_of(text), 256))


def digest_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(digest, doc_id, copies): repeated rows are counted, not listed."""
    rows = docs.select(digest_of(text).alias("digest"), F.col(doc_id).cast("long").alias("doc_id"))
    return rows.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("copies"))


# -- the hash ----------------------------------------------------------------------------


def _wanted(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """The bit each digest wants at a level."""
    with np.errstate(over="ignore"):
        x = (words[:, 1] ^ (np.uint64(level + 1) * _ODD)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29)) ^ words[:, 2]) * np.uint64(0x94D049BB133111EB)
    return ((x >> np.uint64(16)) % np.uint64(size)).astype(np.int64)


def _as_words(digests: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(digests).view("<u8").reshape(-1, DIGEST_BYTES // 8)


def _raw(column) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, column)), dtype=np.uint8).reshape(-1, DIGEST_BYTES)


def build_hash(digests: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit arrays by level, and the slot of each of the distinct ``digests`` (the last slots are for those left over)."""
    words, left = _as_words(digests), np.arange(len(digests))
    slots, levels, before = np.full(len(digests), -1, dtype=np.int64), [], 0
    while len(left) and len(levels) < _LEVELS:
        size = 2 * len(left) + 1
        at = _wanted(words[left], len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        rank = np.cumsum(alone) - 1
        mine = alone[at]
        slots[left[mine]] = before + rank[at[mine]]
        levels.append(np.packbits(alone))
        before, left = before + int(alone.sum()), left[~mine]
    slots[left] = before + np.arange(len(left))
    return levels, slots


def find_slots(levels: list[np.ndarray], sizes: list[int], count: int, probes: np.ndarray, held: np.ndarray) -> np.ndarray:
    """The slot of each probe whose bytes equal the digest held there, else -1."""
    words, found, open_ = _as_words(probes), np.full(len(probes), -1, dtype=np.int64), np.arange(len(probes))
    before = 0
    for level, (packed, size) in enumerate(zip(levels, sizes)):
        bits = np.unpackbits(packed, count=size).astype(bool)
        at = _wanted(words[open_], level, size)
        hit = bits[at]
        found[open_[hit]] = before + (np.cumsum(bits) - 1)[at[hit]]
        before, open_ = before + int(bits.sum()), open_[~hit]
    for slot in range(before, count):  # digests that met others at every level
        found[open_[(probes[open_] == held[slot]).all(axis=1)]] = slot
    known = found >= 0
    known[known] = (held[found[known]] == probes[known]).all(axis=1)
    return np.where(known, found, -1)


# -- the index ---------------------------------------------------------------------------

_INDEX = "shard int, sizes array<int>, levels array<binary>, digests binary, winners binary, named binary, members binary"


def _build_shard(key, rows: pd.DataFrame) -> pd.DataFrame:
    digests = _raw(rows["digest"])
    levels, slots = build_hash(digests)
    order = np.argsort(slots)
    sizes, left = [], len(digests)
    for packed in levels:
        sizes.append(2 * left + 1)
        left -= int(np.unpackbits(packed, count=sizes[-1]).sum())
    named = rows["winner"].notna().to_numpy()
    winners = rows["winner"].fillna(0).astype("int64").to_numpy()
    return pd.DataFrame(
        {
            "shard": [key[0]],
            "sizes": [sizes],
            "levels": [[x.tobytes() for x in levels]],
            "digests": [digests[order].tobytes()],
            "winners": [winners[order].tobytes()],
            "named": [named[order].tobytes()],
            "members": [rows["members"].to_numpy(dtype=np.int64)[order].tobytes()],
        }
    )


@dataclass(frozen=True)
class DigestIndex:
    """``table`` has one row per shard, its digests dealt out by ``shard_of(digest, shards)``."""

    table: DataFrame
    shards: int


def build_index(entries: DataFrame, shards: int) -> DataFrame:
    """One row per shard over ``entries``: (digest, winner, members), each digest once, the winner as text or null."""
    known = entries.withColumn("shard", shard_of(F.col("digest"), shards))

    def build(key, part: pd.DataFrame) -> pd.DataFrame:
        part["winner"] = pd.array([None if x is None else int(x) for x in part["winner"]], dtype="Int64")
        return _build_shard(key, part)

    return known.groupBy("shard").applyInPandas(build, _INDEX)


def _entries(rows: DataFrame) -> DataFrame:
    """(digest, id, copies) of digest rows: the largest id, as text, and the number of rows."""
    return rows.groupBy("digest").agg(F.max("doc_id").cast("string").alias("id"), F.sum("copies").alias("copies"))


def stored_index(entries: DataFrame) -> DigestIndex:
    entries = persist_table(entries, "digest-entries")
    shards = shard_count(entries.count(), KEYS_PER_SHARD)
    return DigestIndex(persist_table(build_index(entries, shards), "digest-index"), shards)


def first_index(rows: DataFrame) -> DigestIndex:
    return stored_index(_entries(rows).select("digest", F.col("id").alias("winner"), F.col("copies").alias("members")))


def entries_of(index: DigestIndex) -> DataFrame:
    """(digest, winner, members) of all slots."""

    def unpack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples():
                winners, named = np.frombuffer(row.winners, dtype=np.int64), np.frombuffer(row.named, dtype=bool)
                size = DIGEST_BYTES
                yield pd.DataFrame(
                    {
                        "digest": [row.digests[k : k + size] for k in range(0, len(row.digests), size)],
                        "winner": [str(w) if ok else None for w, ok in zip(winners.tolist(), named.tolist())],
                        "members": np.frombuffer(row.members, dtype=np.int64),
                    }
                )

    return index.table.mapInPandas(unpack, "digest binary, winner string, members long")


def extend(index: DigestIndex, rows: DataFrame) -> DigestIndex:
    """The index after further digest rows."""
    found = look_up(_entries(rows), index)
    winner = F.greatest(F.col("winner").cast("long"), F.col("id").cast("long")).cast("string")
    met = found.where("member").select("digest", winner.alias("winner"), (F.col("members") + F.col("copies")).alias("members"))
    new = found.where("not member").select("digest", F.col("id").alias("winner"), F.col("copies").alias("members"))
    untouched = entries_of(index).join(met.select("digest"), "digest", "left_anti")
    return stored_index(untouched.unionByName(met).unionByName(new))


def _resolve(probes: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    out = probes[["digest", "id", "copies"]].copy()
    n = len(out)
    if not n:
        return pd.DataFrame({"digest": [], "id": [], "copies": [], "member": [], "winner": [], "members": []})
    slots = np.full(n, -1, dtype=np.int64)
    winners, named, members = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=bool), np.zeros(1, dtype=np.int64)
    if len(index):
        row = index.iloc[0]
        held = np.frombuffer(row["digests"], dtype=np.uint8).reshape(-1, DIGEST_BYTES)
        levels = [np.frombuffer(x, dtype=np.uint8) for x in row["levels"]]
        slots = find_slots(levels, list(row["sizes"]), len(held), _raw(out["digest"]), held)
        winners, members = np.frombuffer(row["winners"], dtype=np.int64), np.frombuffer(row["members"], dtype=np.int64)
        named = np.frombuffer(row["named"], dtype=bool)
    member = slots >= 0
    at = np.where(member, slots, 0)
    out["member"] = member
    out["winner"] = [str(w) if ok else None for w, ok in zip(winners[at].tolist(), (member & named[at]).tolist())]
    out["members"] = np.where(member, members[at], 0)
    return out


def look_up(rows: DataFrame, index: DigestIndex) -> DataFrame:
    """Adds ``member``, ``winner`` and ``members`` to rows (digest, id, copies); stored."""
    probes = rows.select("digest", "id", "copies", shard_of(F.col("digest"), index.shards).alias("shard"))
    schema = "digest binary, id string, copies long, member boolean, winner string, members long"
    return persist_table(lookup(probes, index.table, "id", _resolve, schema), "digests-looked-up")


def exact_dedup_with(
    docs: DataFrame, history: DigestIndex | None = None, doc_id: str = "doc_id", text: str = "text"
) -> tuple[DataFrame, DigestIndex]:
    """One row per document: digest, doc_id, keep_id, group_size, kept; and the index with these documents.

    With ``history`` the rows it has seen count, and one of them may be the row that stays. Without it, the documents
    themselves come in two parts, by a hash of their ids: the second part is resolved against the index of the first.
    """
    rows = persist_table(digest_rows(docs, doc_id, text), "digests")
    if history is None:
        later = F.pmod(F.xxhash64(id_key("doc_id"), F.lit("part")), F.lit(2)) == 1
        index = extend(first_index(rows.where(~later)), rows.where(later))
    else:
        index = extend(history, rows)
    found = look_up(rows.select("digest", F.col("doc_id").cast("string").alias("id"), "copies"), index)
    each = found.select(
        "digest",
        F.col("id").cast("long").alias("doc_id"),
        F.col("winner").cast("long").alias("keep_id"),
        F.col("members").alias("group_size"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"),
    )
    first = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)
    return each.select("digest", "doc_id", "keep_id", "group_size", first.alias("kept")), index


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", history: DigestIndex | None = None) -> DataFrame:
    return exact_dedup_with(docs, history, doc_id, text)[0]


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with the columns they came with."""
    row, digest, nth = unused(docs, "__id", "__digest", "__copy")
    kept = exact_dedup(docs, doc_id, text).where("kept").select(id_key("doc_id").alias(row), F.col("digest").alias(digest))
    marked = docs.withColumns({row: id_key(doc_id), digest: digest_of(text)}).join(kept, [row, digest], "left_semi")
    # Repeated rows have the same id and digest; the join has already brought them together.
    copy = F.row_number().over(Window.partitionBy(row, digest).orderBy(F.lit(0)))
    return marked.withColumn(nth, copy).where(F.col(nth) == 1).select(*docs.columns)
