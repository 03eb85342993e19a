"""Alignment of the tokens of two tokenizers by products of incidence matrices in compressed rows.

For a chunk of documents, A has a row per token of the first tokenizer and a column per byte, B the same for the second.
Gustavson's row products give A·Bᵀ: an entry for each two tokens that share bytes, its value the number of shared bytes.
Bytes where tokens of both end cut the tokens into groups; the incidence of tokens and groups, multiplied in the same way,
gives the links of tokens of the same group. Documents follow each other in one matrix; no token spans two.

How many documents hold a pair of ids linked is counted over the whole corpus in two steps. Documents are stored in blocks
of about ``BLOCK_BYTES`` with their distinct pairs; pairs are counted per block, then over blocks, and the counts return to
each block once per pair instead of once per link. What a task holds is one block.

Defined results: a null or empty text, and a text whose tokens of either tokenizer do not spell a blank and the text, has
no tokens (zeros and ''); special strings in texts are plain text; repeated rows, also with a null id, count as documents
of their own; an empty table gives no rows; texts of any length are taken whole; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ledgerwatch.llm.bpe import PairMerger, byte_letters
from ledgerwatch.llm.common import bounded_batches, text_of
from ledgerwatch.session import persist_table

#: Bytes of text in one chunk of matrices, and in one block of documents; more only for a single longer text.
CHUNK_BYTES = 1_000_000
BLOCK_BYTES = 16_000_000
#: Products of entries expanded at once.
_PRODUCTS = 4_000_000


# -- sparse matrices ---------------------------------------------------------------------


@dataclass
class Rows:
    """A sparse matrix by rows: the columns of row i are ``columns[first[i]:first[i + 1]]``, all values are one."""

    first: np.ndarray
    columns: np.ndarray
    width: int

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.first)

    def transposed(self) -> Rows:
        rows = np.repeat(np.arange(len(self.first) - 1), self.sizes)
        order = np.argsort(self.columns, kind="stable")
        first = np.r_[0, np.cumsum(np.bincount(self.columns, minlength=self.width))]
        return Rows(first, rows[order], len(self.first) - 1)


def products(a: Rows, b: Rows) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Yields a·b as (rows, columns, values) for runs of rows: each row of ``a`` adds up the rows of ``b`` it names."""
    reach = b.sizes[a.columns]
    upto = np.r_[0, np.cumsum(reach)]
    work = upto[a.first]
    row, last = 0, len(a.first) - 1
    while row < last:
        # As many rows as stay below the bound, one at least.
        end = max(row + 1, int(np.searchsorted(work, work[row] + _PRODUCTS, side="right")) - 1)
        entries = slice(a.first[row], a.first[end])
        size = reach[entries]
        total = int(size.sum())
        at = np.repeat(b.first[a.columns[entries]] - (upto[entries] - work[row]), size) + np.arange(total)
        of = np.repeat(np.repeat(np.arange(row, end), a.sizes[row:end]), size)
        key = of * np.int64(b.width) + b.columns[at]
        if np.any(key[1:] < key[:-1]):
            key.sort(kind="stable")
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][:total])
        values = np.diff(np.r_[new, total])
        yield key[new] // b.width, key[new] % b.width, values
        row = end


# -- tokenizers --------------------------------------------------------------------------


class Vocabulary:
    """The bytes of each id, one after another."""

    def __init__(self, spelled: list[bytes]):
        self.sizes = np.fromiter(map(len, spelled), np.int64, len(spelled))
        self._first = np.r_[0, np.cumsum(self.sizes)]
        self._pool = np.frombuffer(b"".join(spelled), np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        size = self.sizes[ids]
        upto = np.cumsum(size)
        return self._pool[np.repeat(self._first[ids] - (upto - size), size) + np.arange(int(upto[-1]) if len(upto) else 0)]


class Tokenizers:
    """Both tokenizers in a worker: ids and spelling."""

    def __init__(self, a_path: str, b_path: str):
        import json

        import sentencepiece

        self._a = PairMerger(a_path)
        # Their strings in texts are plain text here.
        self._a.special = {}
        with open(a_path, encoding="utf-8") as file:
            data = json.load(file)
        entries = data["model"]["vocab"] | {x["content"]: x["id"] for x in data["added_tokens"]}
        value = {letter: b for b, letter in enumerate(byte_letters())}
        spelled = [b""] * (max(entries.values()) + 1)
        for entry, number in entries.items():
            spelled[number] = bytes(value[c] for c in entry) if all(c in value for c in entry) else entry.encode()
        self.a = Vocabulary(spelled)
        self._b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self._b.id_to_piece(k) for k in range(self._b.vocab_size())]
        self.b = Vocabulary(
            [bytes([int(p[3:5], 16)]) if self._b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        )

    def ids(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        first = [x.astype(np.int64) for x in self._a.ids([" " + t for t in texts])]
        return first, [np.array(x, dtype=np.int64) for x in self._b.encode(texts, num_threads=1)]


@functools.lru_cache(maxsize=2)
def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


# -- one chunk of documents --------------------------------------------------------------


@dataclass
class Aligned:
    """The tokens of a chunk of documents; positions, groups and bytes run on over all of them."""

    a_ids: np.ndarray
    b_ids: np.ndarray
    a_first: np.ndarray  # of each document, and the end
    b_first: np.ndarray
    a_group: np.ndarray  # the group of each token
    b_group: np.ndarray
    group_first: np.ndarray
    a_bytes: Rows
    b_bytes: Rows

    def overlap_links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        return products(self.a_bytes, self.b_bytes.transposed())

    def group_links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        groups = int(self.group_first[-1])
        a, b = (Rows(np.arange(len(g) + 1), g, groups) for g in (self.a_group, self.b_group))
        return products(a, b.transposed())

    def group_link_counts(self) -> np.ndarray:
        """The number of group links of each document: a token of A links with all of B in its group."""
        in_group = np.bincount(self.b_group, minlength=int(self.group_first[-1]))
        return _sums(in_group[self.a_group], self.a_first)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    upto = np.r_[0, np.cumsum(values)]
    return upto[first[1:]] - upto[first[:-1]]


def align(texts: list[str], both: Tokenizers) -> Aligned:
    """The tokens of some texts, none for a text that either side does not spell."""
    a, b = both.ids(texts)
    none = np.zeros(0, dtype=np.int64)
    for k, text in enumerate(texts):
        wanted = (" " + text).encode()
        if not text or any(v.spell(x[k]).tobytes() != wanted for v, x in ((both.a, a), (both.b, b))):
            a[k] = b[k] = none
    firsts = [np.r_[0, np.cumsum([len(x) for x in side])].astype(np.int64) for side in (a, b)]
    ids = [np.concatenate([none, *side]) for side in (a, b)]
    ends = [np.cumsum(v.sizes[x]) for v, x in zip((both.a, both.b), ids)]
    common = np.intersect1d(*ends, assume_unique=True)
    groups = [np.searchsorted(common, e) for e in ends]
    n = int(ends[0][-1]) if len(ends[0]) else 0
    rows = [Rows(np.r_[0, e], np.arange(n), n) for e in ends]
    doc_end = np.r_[0, ends[0]][firsts[0]]
    return Aligned(*ids, *firsts, *groups, np.searchsorted(common, doc_end, side="right"), *rows)


@functools.lru_cache(maxsize=4)
def _numerals(size: int, inner: str, outer: str) -> np.ndarray:
    """Decimal numbers with the mark that follows them, ``outer`` after the last of its side in a group, padded with zero bytes."""
    width = len(str(size)) + 1
    spelled = [[f"{k}{mark}".encode().ljust(width, b"\0") for k in range(size)] for mark in (inner, outer)]
    return np.frombuffer(b"".join(spelled[0] + spelled[1]), np.uint8).reshape(2, size, width)


def group_texts(x: Aligned, a_size: int, b_size: int) -> Iterator[bytes]:
    """Per document its groups, ``a1,a2|b1;a3|b2,b3``."""
    groups = int(x.group_first[-1])
    a_count, b_count = (np.bincount(g, minlength=groups) for g in (x.a_group, x.b_group))
    # Tokens of a group stand together, those of A first.
    a_place = np.arange(len(x.a_ids)) + (np.cumsum(b_count) - b_count)[x.a_group]
    b_place = np.arange(len(x.b_ids)) + np.cumsum(a_count)[x.b_group]
    a_last, b_last = (np.r_[g[1:] != g[:-1], True][: len(g)].astype(np.int64) for g in (x.a_group, x.b_group))
    a_marks, b_marks = _numerals(a_size, ",", "|"), _numerals(b_size, ",", ";")
    width = max(a_marks.shape[2], b_marks.shape[2])
    out = np.zeros((len(x.a_ids) + len(x.b_ids), width), np.uint8)
    out[a_place, : a_marks.shape[2]] = a_marks[a_last, x.a_ids]
    out[b_place, : b_marks.shape[2]] = b_marks[b_last, x.b_ids]
    first = x.a_first + x.b_first
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        part = out[a:b].ravel()
        yield part[part != 0].tobytes()[:-1]


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for k, text in enumerate(texts):
        more = len(text.encode())
        if k > first and size + more > CHUNK_BYTES:
            yield first, k
            first, size = k, 0
        size += more
    if len(texts) > first:
        yield first, len(texts)


# -- documents ---------------------------------------------------------------------------

_STORED = (
    "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_group_links long, groups_sha256 string,"
    " pairs array<long>, times array<int>"
)


def aligned_documents(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its counts, the digest of its groups, and its distinct linked pairs of ids with their numbers of links.

    A pair is ``a * (size of the second vocabulary) + b``.
    """
    bounded_batches(docs.sparkSession)
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(a_path, b_path)
        block, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, j in _chunks(texts):
                size = sum(map(len, texts[i:j]))
                if held and held + size > BLOCK_BYTES:
                    block, held = block + 1, 0
                held += size
                yield _measured(block, batch.column("doc_id").slice(i, j - i), texts[i:j], both)

    return plain.mapInArrow(measure, _STORED)


def _measured(block: int, ids: pa.Array, texts: list[str], both: Tokenizers) -> pa.RecordBatch:
    x = align(texts, both)
    n = len(texts)
    parts = [[np.zeros(0, dtype=np.int64)] * 2]
    for a, b, _ in x.overlap_links():
        doc = np.searchsorted(x.a_first, a, side="right") - 1
        parts.append([doc, x.a_ids[a] * len(both.b.sizes) + x.b_ids[b]])
    doc, pair = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((pair, doc))
    doc, pair = doc[order], pair[order]
    new = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])][: len(pair)])
    times = np.diff(np.r_[new, len(pair)])
    offsets = pa.array(np.r_[0, np.cumsum(np.bincount(doc[new], minlength=n))].astype(np.int32))
    n_a, n_b = np.diff(x.a_first), np.diff(x.b_first)
    digests = [hashlib.sha256(t).hexdigest() if k else "" for k, t in zip(n_a.tolist(), group_texts(x, len(both.a.sizes), len(both.b.sizes)))]
    counts = (n_a, n_b, np.diff(x.group_first), np.bincount(doc, minlength=n), x.group_link_counts())
    columns = [pa.array(np.full(n, block)), ids, *(pa.array(c.astype(np.int64)) for c in counts), pa.array(digests, pa.string())]
    columns += [pa.ListArray.from_arrays(offsets, pa.array(v, k)) for v, k in ((pair[new], pa.int64()), (times.astype(np.int32), pa.int32()))]
    names = [c.split()[0] for c in _STORED.split(",")]
    return pa.RecordBatch.from_arrays(columns, names=names)


def pair_counts(held: DataFrame, width: int) -> DataFrame:
    """(pair, n_docs, is_best) from (pair, n) per block: ``is_best`` where no pair of its first id is in more documents."""
    counts = held.groupBy("pair").agg(F.sum("n").alias("n_docs")).withColumn("a_id", F.floor(F.col("pair") / width))
    best = counts.groupBy("a_id").agg(F.max("n_docs").alias("most"))
    return counts.join(best, "a_id").select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("is_best"))


def alignment(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_group_links, n_best, count_sum, groups_sha256."""
    stored = persist_table(aligned_documents(docs, a_path, b_path, doc_id, text), "aligned")
    # A block's rows lie in one file, so that they are counted before they are shuffled.
    pairs = stored.select("block", F.explode("pairs").alias("pair"))
    held = persist_table(pairs.groupBy("block", "pair").agg(F.count(F.lit(1)).alias("n")), "pairs")
    back = held.select("block", "pair").join(pair_counts(held, _width(b_path)), "pair")
    rows = stored.groupBy("block").cogroup(back.groupBy("block"))
    return rows.applyInArrow(
        _scored, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_group_links long, n_best long, count_sum long, groups_sha256 string"
    )


def _width(b_path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=b_path).vocab_size()


def _scored(key, docs: pa.Table, pairs: pa.Table) -> pa.Table:
    order = np.argsort(pairs.column("pair").to_numpy())
    pair, count, best = (pairs.column(c).to_numpy()[order] for c in ("pair", "n_docs", "is_best"))
    held, times = docs.column("pairs").combine_chunks(), docs.column("times").combine_chunks().flatten().to_numpy()
    first = np.r_[0, np.cumsum(held.value_lengths().to_numpy(zero_copy_only=False))]
    at = np.searchsorted(pair, held.flatten().to_numpy())
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_group_links"]
    columns = {c: docs.column(c) for c in names}
    columns["n_best"] = pa.array(_sums(times * best[at].astype(np.int64), first))
    columns["count_sum"] = pa.array(_sums(times * count[at], first))
    return pa.table(columns | {"groups_sha256": docs.column("groups_sha256")})


def token_links(docs: DataFrame, a_path: str, b_path: str, groups: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per link: doc_id, a_at and b_at (token numbers in the document), a_id, b_id, weight.

    Links are overlaps with the number of shared bytes; with ``groups`` those of tokens of one group, which grow with the
    square of a group.
    """
    bounded_batches(docs.sparkSession)
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(a_path, b_path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, j in _chunks(texts):
                x = align(texts[i:j], both)
                for a, b, weight in x.group_links() if groups else x.overlap_links():
                    doc = np.searchsorted(x.a_first, a, side="right") - 1
                    places = (a - x.a_first[doc], b - x.b_first[doc], x.a_ids[a], x.b_ids[b], weight)
                    columns = [batch.column("doc_id").slice(i, j - i).take(pa.array(doc)), *(pa.array(c.astype(np.int64)) for c in places)]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "a_at", "b_at", "a_id", "b_id", "weight"])

    return plain.mapInArrow(link, "doc_id long, a_at long, b_at long, a_id long, b_id long, weight long")
