"""Line dedup that can be taken back: sharded cuckoo filters over exact reference-count tables.

The state has three tables. ``references`` holds every line with a long enough key: (shard, key, doc_id, position).
``counts`` holds per key the number of documents and the largest of their ids. ``filters`` holds per shard a cuckoo
filter of the keys that are repeated often enough to be dropped. Inserting documents adds references and puts keys that
reach the limit into the filter; deleting documents removes references, counts again and takes keys that fall below the
limit out of the filter, which a cuckoo filter can do and a Bloom filter cannot.

Each table is a list of stored parts, one per change: what a change writes are its own references, or the ids that have
gone, the counts of the keys it touches and the filters of the shards where a key has crossed the limit. Of a key or a shard
the newest part counts. A failed change leaves the old state as it was. After ``PARTS`` changes the parts are folded into
one, and dealt into more shards if the keys have become too many for the old ones.

Documents are cleaned by their references: the shard's filter passes the few that may be repeated, the exact counts
decide on these, and a document gets the positions to drop. Only documents' own texts travel to their positions. A
shard whose lines are many, as one very common line makes it, is looked up in several parts.

``clean`` looks up the references of the documents it is given, not those of all.

Defined results: a document that is inserted again with the same text changes nothing, and with another text has the lines
of both until it is deleted; a null or empty text is one empty line; rows with the same id are one document for the counts, and each
is cleaned; a null id counts as one document, the smallest; an empty table gives no rows; ``\\r`` before a line's end is part
of the line but not of its key; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerwatch.llm.common import bounded_batches, id_key, lookup, shard_count, text_of
from ledgerwatch.session import persist_table

MIN_CHARS = 40
MIN_DOCS = 5
KEY_BYTES = 16
KEYS_PER_SHARD = 200_000
#: Changes between two foldings of the stored parts.
PARTS = 16
_SLOTS = 4
_KICKS = 500
_BLANK = " \t\n\x0b\x0c\r"
_STEP = np.uint64(0x9E3779B97F4A7C15)


# -- the filter --------------------------------------------------------------------------


class CuckooFilter:
    """16-bit fingerprints in buckets of four; a fingerprint that finds no place after many moves goes to a short list."""

    def __init__(self, buckets: int, table: np.ndarray | None = None, rest: np.ndarray | None = None):
        self.buckets = buckets
        self.table = np.zeros((buckets, _SLOTS), dtype=np.uint16) if table is None else table
        self.rest = [] if rest is None else rest.tolist()

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        return cls(max(1, 1 << int(np.ceil(np.log2(max(1, keys) / (_SLOTS * 0.8))))))

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint, first and second bucket of keys, which are rows of two words."""
        mark = (keys[:, 0] >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        first = (keys[:, 1] % np.uint64(self.buckets)).astype(np.int64)
        return mark, first, self._other(first, mark)

    def _other(self, bucket, mark):
        mixed = (np.asarray(mark, dtype=np.uint64) * _STEP) >> np.uint64(32)
        return (np.asarray(bucket) ^ (mixed % np.uint64(self.buckets)).astype(np.int64)) % self.buckets

    def insert(self, keys: np.ndarray) -> None:
        mark, first, second = self.places(keys)
        for m, a, b in zip(mark.tolist(), first.tolist(), second.tolist()):
            if not self._put(m, a) and not self._put(m, b):
                self._move(m, b)

    def _put(self, mark: int, bucket: int) -> bool:
        free = np.flatnonzero(self.table[bucket] == 0)
        if len(free):
            self.table[bucket, free[0]] = mark
        return len(free) > 0

    def _move(self, mark: int, bucket: int) -> None:
        for turn in range(_KICKS):
            slot = turn % _SLOTS
            mark, self.table[bucket, slot] = int(self.table[bucket, slot]), mark
            bucket = int(self._other(bucket, mark))
            if self._put(mark, bucket):
                return
        self.rest.append((bucket << 16) | mark)

    def delete(self, keys: np.ndarray) -> None:
        """Takes out keys that were inserted before."""
        mark, first, second = self.places(keys)
        for m, a, b in zip(mark.tolist(), first.tolist(), second.tolist()):
            for bucket in (a, b):
                held = np.flatnonzero(self.table[bucket] == m)
                if len(held):
                    self.table[bucket, held[0]] = 0
                    break
            else:
                self.rest.remove(next(x for x in self.rest if x in ((a << 16) | m, (b << 16) | m)))

    def has_room(self, more: int) -> bool:
        return np.count_nonzero(self.table) + len(self.rest) + more <= 0.9 * self.table.size

    def crowded(self) -> bool:
        return len(self.rest) > 64 or bool(np.count_nonzero(self.table) > 0.95 * self.table.size)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, first, second = self.places(keys)
        found = (self.table[first] == mark[:, None]).any(axis=1) | (self.table[second] == mark[:, None]).any(axis=1)
        if self.rest:
            found |= np.isin((first << 16) | mark, self.rest) | np.isin((second << 16) | mark, self.rest)
        return found


def _words(keys) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, keys)), dtype="<u8").reshape(-1, KEY_BYTES // 8)


_FILTER = "shard int, buckets long, marks binary, rest array<long>, crowded boolean"


def _row(shard: int, held: CuckooFilter) -> pd.DataFrame:
    row = {"shard": [shard], "buckets": [held.buckets], "marks": [held.table.tobytes()], "rest": [held.rest]}
    return pd.DataFrame(row | {"crowded": [held.crowded()]})


def _filter(row) -> CuckooFilter:
    table = np.frombuffer(row["marks"], dtype=np.uint16).reshape(-1, _SLOTS).copy()
    return CuckooFilter(int(row["buckets"]), table, np.asarray(row["rest"], dtype=np.int64))


# -- references --------------------------------------------------------------------------


def line_key(line: str) -> str:
    """The line without blanks at its ends, A-Z lowered."""
    line = line.strip(_BLANK)
    return line.lower() if line.isascii() else line.encode().lower().decode()


def references(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(shard, key, doc_id, id, row, position) of every line whose key is long enough."""
    bounded_batches(docs.sparkSession)
    plain = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        id_key(doc_id).alias("id"),
        text_of(text).alias("text"),
        F.xxhash64(text_of(text)).alias("row"),
    )

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, keys, places = [], [], []
            for k, value in enumerate(batch.column("text")):
                for place, line in enumerate(value.as_py().split("\n")):
                    if len(line) >= min_chars:
                        key = line_key(line)
                        if len(key) >= min_chars:
                            owner.append(k)
                            keys.append(hashlib.blake2b(key.encode(), digest_size=KEY_BYTES).digest())
                            places.append(place)
            shard = _words(keys)[:, 0] % np.uint64(shards) if keys else []
            own = batch.select(["doc_id", "id", "row"]).take(pa.array(owner, pa.int64()))
            columns = [pa.array(np.asarray(shard, dtype=np.int32)), pa.array(keys, pa.binary()), *own.columns, pa.array(places, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "key", "doc_id", "id", "row", "position"])

    return plain.mapInArrow(lines, _REFERENCES)


def _count(refs: DataFrame) -> DataFrame:
    per_doc = refs.groupBy("shard", "key", "doc_id").agg(F.count(F.lit(1)).alias("lines"))
    return per_doc.groupBy("shard", "key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"), F.sum("lines").alias("lines"))


# -- the state ---------------------------------------------------------------------------

_REFERENCES = "shard int, key binary, doc_id long, id string, row long, position int"
_COUNTS = "shard int, key binary, n_docs long, keeper long, lines long"


def _all(parts: tuple[DataFrame, ...]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class LineState:
    """The stored parts of the three tables, each row with the ``version`` that wrote it."""

    added: tuple[DataFrame, ...]
    removed: tuple[DataFrame, ...]
    counted: tuple[DataFrame, ...]
    filtered: tuple[DataFrame, ...]
    shards: int
    min_docs: int = MIN_DOCS
    keys_per_shard: int = KEYS_PER_SHARD
    version: int = 1

    @property
    def references(self) -> DataFrame:
        rows = _all(self.added)
        if self.removed:
            gone = _all(self.removed).groupBy("id").agg(F.max("version").alias("gone"))
            rows = rows.join(gone, "id", "left").where("gone is null or version > gone").drop("gone")
        return rows.drop("version")

    @property
    def counts(self) -> DataFrame:
        """(shard, key, n_docs, keeper, lines) of the keys that some document has."""
        rows = _all(self.counted)
        if len(self.counted) > 1:
            newest = F.max(F.struct("version", "n_docs", "keeper", "lines")).alias("newest")
            rows = rows.groupBy("shard", "key").agg(newest).select("shard", "key", "newest.*")
        return rows.where("n_docs > 0").drop("version")

    @property
    def repeated(self) -> DataFrame:
        return self.counts.where(F.col("n_docs") >= self.min_docs)

    @property
    def filters(self) -> DataFrame:
        rows = _all(self.filtered)
        if len(self.filtered) > 1:
            marks = [f.split()[0] for f in _FILTER.split(", ")]
            rows = rows.groupBy("shard").agg(F.max_by(F.struct(*marks), "version").alias("newest")).select("newest.*")
        return rows.drop("version")


def _stored(rows: DataFrame, version: int, name: str) -> DataFrame:
    return persist_table(rows.withColumn("version", F.lit(version)), name)


def _rebuilt(repeated: DataFrame) -> DataFrame:
    def build(key, rows: pd.DataFrame) -> pd.DataFrame:
        held = CuckooFilter.sized(2 * len(rows))
        held.insert(_words(rows["key"]))
        return _row(key[0], held)

    return repeated.select("shard", "key").groupBy("shard").applyInPandas(build, _FILTER)


def _changed_filters(state: LineState, moved: DataFrame, repeated: DataFrame) -> DataFrame:
    """The filters of the shards with a key in ``moved`` (shard, key, add); one without room is built anew from the exact keys."""

    def change(key, old: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return _row(0, CuckooFilter(1)).iloc[:0]
        add = rows["add"].to_numpy(dtype=bool)
        held = _filter(old.iloc[0]) if len(old) else CuckooFilter.sized(2 * int(add.sum()))
        if not add.all():
            held.delete(_words(rows["key"][~add]))
        if not held.has_room(int(add.sum())):
            return _row(key[0], held).assign(crowded=True)
        held.insert(_words(rows["key"][add]))
        return _row(key[0], held)

    changed = state.filters.groupBy("shard").cogroup(moved.groupBy("shard")).applyInPandas(change, _FILTER)
    changed = persist_table(changed, "line-filters")
    full = changed.where("crowded").select("shard")
    return changed.where("not crowded").unionByName(_rebuilt(repeated.join(full, "shard", "left_semi")))


def start(docs: DataFrame, min_docs: int = MIN_DOCS, doc_id: str = "doc_id", text: str = "text", keys_per_shard: int = KEYS_PER_SHARD) -> LineState:
    """The state of a first batch. The number of shards follows the number of documents, later that of the keys."""
    shards = shard_count(docs.count() * 16, keys_per_shard)
    refs = _stored(references(docs, shards, doc_id, text), 1, "line-references")
    counts = _stored(_count(refs), 1, "line-counts")
    filters = _stored(_rebuilt(counts.where(F.col("n_docs") >= min_docs)), 1, "line-filters")
    return LineState((refs,), (), (counts,), (filters,), shards, min_docs, keys_per_shard)


def _recounted(old: LineState, state: LineState, touched: DataFrame) -> LineState:
    """``state`` with the counts of the keys ``touched`` and the filters that change with them."""
    fresh = _count(state.references.join(touched, ["shard", "key"], "left_semi"))
    before = old.counts.select("shard", "key", F.col("n_docs").alias("was"))
    rows = touched.join(fresh, ["shard", "key"], "left").join(before, ["shard", "key"], "left")
    rows = persist_table(rows.fillna(0, ["n_docs", "lines", "was"]).withColumn("version", F.lit(state.version)), "line-counts")
    state = replace(state, counted=(*state.counted, rows.drop("was")))
    often = F.col("n_docs") >= state.min_docs
    moved = rows.where(often != (F.col("was") >= state.min_docs)).select("shard", "key", often.alias("add"))
    filters = _stored(_changed_filters(old, moved, state.repeated), state.version, "line-filters")
    state = replace(state, filtered=(*state.filtered, filters))
    return folded(state) if state.version % PARTS == 0 else state


def insert(state: LineState, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> LineState:
    """The state after documents have come in."""
    version = state.version + 1
    new = _stored(references(docs, state.shards, doc_id, text), version, "line-references")
    touched = persist_table(new.select("shard", "key").distinct(), "line-keys")
    return _recounted(state, replace(state, added=(*state.added, new), version=version), touched)


def delete(state: LineState, ids: DataFrame, doc_id: str = "doc_id") -> LineState:
    """The state after the documents with these ids have gone."""
    version = state.version + 1
    gone = _stored(ids.select(id_key(doc_id).alias("id")).distinct(), version, "line-ids")
    touched = state.references.join(gone.select("id"), "id", "left_semi").select("shard", "key").distinct()
    return _recounted(state, replace(state, removed=(*state.removed, gone), version=version), persist_table(touched, "line-keys"))


def folded(state: LineState) -> LineState:
    """The same state in one part per table, in more shards if their keys have become twice too many."""
    shards = max(state.shards, shard_count(state.counts.count(), 2 * state.keys_per_shard))

    def dealt(rows: DataFrame, schema: str) -> DataFrame:
        if shards == state.shards:
            return rows

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                shard = _words(batch.column("key").to_pylist())[:, 0] % np.uint64(shards)
                yield batch.set_column(batch.schema.get_field_index("shard"), "shard", pa.array(shard.astype(np.int32)))

        return rows.select(*[f.split()[0] for f in schema.split(", ")]).mapInArrow(deal, schema)

    refs = _stored(dealt(state.references, _REFERENCES), state.version, "line-references")
    counts = _stored(dealt(state.counts, _COUNTS), state.version, "line-counts")
    repeated = counts.where(F.col("n_docs") >= state.min_docs)
    filters = _stored(state.filters if shards == state.shards else _rebuilt(repeated), state.version, "line-filters")
    return replace(state, added=(refs,), removed=(), counted=(counts,), filtered=(filters,), shards=shards)


def _pass(probes: pd.DataFrame, row: pd.DataFrame) -> pd.DataFrame:
    names = ["shard", "key", "keeper_mark", "id", "row", "position"]
    if not len(probes) or not len(row):
        return probes[names].iloc[:0]
    return probes[names][_filter(row.iloc[0]).contains(_words(probes["key"]))]


def dropped_positions(state: LineState, ids: DataFrame | None = None) -> DataFrame:
    """(id, row, positions) of the documents that lose lines; of those in ``ids`` (id) alone, if given."""
    refs = state.references if ids is None else state.references.join(ids, "id", "left_semi")
    probes = refs.select("shard", "key", F.col("doc_id").cast("string").alias("keeper_mark"), "id", "row", "position")
    schema = "shard int, key binary, keeper_mark string, id string, row long, position int"
    maybe = lookup(probes, state.filters, ["id", "row", "position"], _pass, schema, rows_per_group=250_000)
    often = state.repeated.select("shard", "key", F.col("keeper").cast("string").alias("_keeper"))
    lost = maybe.join(often, ["shard", "key"]).where(~F.col("keeper_mark").eqNullSafe(F.col("_keeper")))
    return lost.groupBy("id", "row").agg(F.collect_set("position").alias("positions"))


def _kept(lines: Column, positions: Column) -> Column:
    """The lines at other positions; both lists are read once."""
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), positions)
    return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")


def clean(state: LineState, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", every: bool = False) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, kept_text. ``every``: ``docs`` are all the state knows."""
    body = text_of(text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), id_key(doc_id).alias("id"), F.xxhash64(body).alias("row"), body.alias("text"))
    ids = None if every else rows.select("id").distinct()
    rows = rows.join(dropped_positions(state, ids), ["id", "row"], "left")
    rows = rows.withColumn("_lines", F.split("text", "\n", -1))
    kept = F.when(F.col("positions").isNull(), F.col("text")).otherwise(_kept(F.col("_lines"), F.col("positions")))
    return rows.select(
        "doc_id",
        F.size("_lines").cast("long").alias("n_lines"),
        F.when(F.col("positions").isNull(), 0).otherwise(F.size("positions")).cast("long").alias("n_dropped"),
        kept.alias("kept_text"),
    )


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All documents in one batch, cleaned."""
    return clean(start(docs, doc_id=doc_id, text=text), docs, doc_id, text, every=True)
