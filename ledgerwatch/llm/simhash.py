"""SimHash near-dedup over a hierarchical index in Gray order.

Fingerprints that differ in at most ``DISTANCE`` = 4 of 64 bits agree on two of six runs of bits, so each distinct
fingerprint is filed under its 15 masked patterns of two runs: the top nodes of the index. Below a top node the
fingerprints are sorted by Gray rank, where neighbours share most bits, and grouped into nodes of 16, these again into
nodes of 16, and so on. A node holds the bits that all below it share. Two nodes are compared on the bits both hold and
their parents did not, the differences are added to those of the parents, and beyond four the pair is dropped with all
below it. A top node with many fingerprints is cut into blocks, and pairs of blocks are searched apart.

Of the links found below a node only a spanning forest leaves the task; links between different fingerprints are never
listed pairwise. Alternating star contraction joins the forests of all nodes to components.

Equal fingerprints are one entry from the start, so copies cost nothing. No fingerprints go to the driver.

Defined results: null and empty texts have fingerprint zero and link with each other like any others; a null id joins
groups but names one only if no id does; repeated rows are rows of one group; an empty table gives no rows; other columns
are ignored, or kept by ``drop_near_copies``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerwatch.llm.common import bounded_batches, id_key, text_of, unused
from ledgerwatch.session import persist_table

BITS = 64
DISTANCE = 4
SHINGLE = 4
SEED = 42
#: Runs of bits; one more than two per differing bit would need, so that two of them always agree.
RUNS = DISTANCE + 2
FAN = 16
#: A top node with more fingerprints than this is cut.
BLOCK = 8192
_PAIRS_AT_ONCE = 4096


# -- fingerprints ------------------------------------------------------------------------


def fingerprint(text: str) -> int:
    """The unsigned fingerprint of a whole text."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    size = min(SHINGLE, len(words))
    starts = np.r_[0, ends[:-1] + 1][: len(words) - size + 1]
    digest = xxhash.xxh64_intdigest
    spans = zip(starts.tolist(), ends[size - 1 :].tolist())
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(hashes), 65536):
        part = hashes[k : k + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, text_hash) of every document."""
    bounded_batches(docs.sparkSession)
    body = text_of(text)
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("text_hash"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in batch.column("text")), np.uint64, batch.num_rows)
            columns = [batch.column("doc_id"), pa.array(fps.view(np.int64)), batch.column("text_hash")]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", "text_hash"])

    return plain.mapInArrow(mark, "doc_id long, fp long, text_hash long")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), BITS // 4, "0"))


# -- the index below the top nodes -------------------------------------------------------


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """The place of each fingerprint in the Gray sequence."""
    out = fps.copy()
    for k in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(k)
    return out


def _levels(groups: np.ndarray, fps: np.ndarray) -> list[dict[str, np.ndarray]]:
    """From the single fingerprints up to one node per group: held bits, their values, first child, children."""
    n = len(fps)
    level = {"group": groups, "held": np.full(n, ~np.uint64(0)), "value": fps}
    levels = [level]
    while True:
        group = level["group"]
        opens = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        if len(levels) > 1 and len(opens) == len(group):
            return levels
        nth = np.arange(len(group)) - np.repeat(opens, np.diff(np.r_[opens, len(group)]))
        first = np.flatnonzero(nth % FAN == 0)
        ones = np.bitwise_and.reduceat(level["held"] & level["value"], first)
        zeros = np.bitwise_and.reduceat(level["held"] & ~level["value"], first)
        level = {
            "group": group[first],
            "held": ones | zeros,
            "value": ones,
            "first": first,
            "children": np.diff(np.r_[first, len(group)]),
        }
        levels.append(level)


class _Forest:
    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while True:
                above = self.root[self.root]
                if (above == self.root).all():
                    break
                self.root = above


def link(groups: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """For each of the fingerprints, sorted by group and Gray rank, the first one it is linked to within its group."""
    levels, forest = _levels(groups, fps), _Forest(len(fps))
    top = np.arange(len(levels[-1]["group"]))
    open_ = [(len(levels) - 1, top, top, np.zeros(len(top), dtype=np.uint8), levels[-1]["held"])]
    while open_:
        height, u, v, apart, seen = open_.pop()
        if len(u) > _PAIRS_AT_ONCE:
            for k in range(0, len(u), _PAIRS_AT_ONCE):
                part = slice(k, k + _PAIRS_AT_ONCE)
                open_.append((height, u[part], v[part], apart[part], seen[part]))
            continue
        node, below = levels[height], levels[height - 1]
        wide, high = node["children"][u], node["children"][v]
        many = wide * high
        pair = np.repeat(np.arange(len(u)), many)
        nth = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        a = node["first"][u][pair] + nth // high[pair]
        b = node["first"][v][pair] + nth % high[pair]
        once = a < b if height == 1 else a <= b
        pair, a, b = pair[once], a[once], b[once]
        both = below["held"][a] & below["held"][b]
        new = (below["value"][a] ^ below["value"][b]) & both & ~seen[pair]
        apart = apart[pair] + np.bitwise_count(new)
        near = apart <= DISTANCE
        if height == 1:
            forest.join(a[near], b[near])
        elif near.any():
            open_.append((height - 1, a[near], b[near], apart[near], both[near]))
    return forest.root


def _masks() -> list[int]:
    edges = [round(k * BITS / RUNS) for k in range(RUNS + 1)]
    runs = [sum(1 << b for b in range(x, y)) for x, y in zip(edges, edges[1:])]
    masks = [a | b for a, b in combinations(runs, 2)]
    return [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in masks]


def _gray(fp: Column) -> Column:
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, k))
    return fp


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links of the groups in a partition sorted by group; a group may go on in the next batch."""

    def links(groups: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        root = link(groups, fps)
        linked = np.flatnonzero(root != np.arange(len(root)))
        ends = [pa.array(x.view(np.int64)) for x in (fps[linked], fps[root[linked]])]
        return pa.RecordBatch.from_arrays(ends, names=["a", "b"])

    groups, fps = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    for batch in batches:
        groups = np.r_[groups, batch.column("node").to_numpy()]
        fps = np.r_[fps, batch.column("fp").to_numpy().view(np.uint64)]
        whole = int(np.flatnonzero(groups != groups[-1])[-1]) + 1 if (groups != groups[-1]).any() else 0
        if whole:
            yield links(groups[:whole], fps[:whole])
            groups, fps = groups[whole:], fps[whole:]
    if len(groups):
        yield links(groups, fps)


def near_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) that connect all fingerprints ``fp`` within ``DISTANCE`` of each other."""
    masks = F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(_masks())])
    filed = distinct.select("fp", F.explode(masks).alias("top"))
    sizes = filed.groupBy("top").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    blocks = F.ceil(F.col("_n") / BLOCK).cast("int")
    filed = filed.join(sizes.select("top", blocks.alias("_blocks")), "top")
    own = F.pmod(F.xxhash64("fp", F.lit("block")), F.col("_blocks"))
    filed = filed.select("fp", "top", own.cast("int").alias("_own"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other"))
    node = F.xxhash64("top", F.least("_own", "_other"), F.greatest("_own", "_other")).alias("node")
    parts = filed.select(node, "fp").repartition("node").sortWithinPartitions("node", _gray(F.col("fp")))
    return parts.mapInArrow(_search, "a long, b long")


# -- components --------------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """(fp, root) for every end of a link: alternating large and small stars until nothing changes."""
    edges, before = _ordered(links), None
    while True:
        edges = persist_table(edges, "links")
        row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(row) == before or not row[0]:
            return edges.select(F.col("a").alias("fp"), F.col("b").alias("root"))
        before = tuple(row)
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # What is joined by a hub's fingerprint is stored first, so that the join is free to split the hub.
        least = persist_table(ends.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m")), "least-stars")
        large = ends.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("_m").alias("b"))
        large = persist_table(_ordered(large), "large-stars")
        least = persist_table(large.groupBy("a").agg(F.min("b").alias("_m")), "large-least")
        small = large.join(least, "a")
        edges = _ordered(small.select("b", F.col("_m").alias("a")).unionByName(small.select(F.col("a").alias("b"), F.col("_m").alias("a"))))


def _ordered(edges: DataFrame) -> DataFrame:
    """Each link once, from the larger end to the smaller."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _groups(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The stored fingerprints of all documents, and (fp, root) of all distinct ones."""
    marked = persist_table(fingerprints(docs, doc_id, text), "fingerprints")
    distinct = persist_table(marked.select("fp").distinct(), "distinct-fingerprints")
    linked = components(near_links(distinct))
    roots = distinct.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return marked, persist_table(roots, "roots")


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id."""
    marked, roots = _groups(docs, doc_id, text)
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("_least")).join(roots, "fp")
    # Stored, as in components, since one root may have very many fingerprints.
    names = persist_table(least.groupBy("root").agg(F.min("_least").alias("component_id")), "component-names")
    named = roots.join(names, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, that with the smallest id, with the columns it came with."""
    marked, roots = _groups(docs, doc_id, text)
    order = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    best = marked.groupBy("fp").agg(order.alias("best")).join(roots, "fp").groupBy("root").agg(F.min("best").alias("best"))
    row, hashed, nth = unused(docs, "__id", "__hash", "__copy")
    best = best.select("best.doc_id", "best.text_hash").select(id_key("doc_id").alias(row), F.col("text_hash").alias(hashed))
    marked = docs.withColumns({row: id_key(doc_id), hashed: F.xxhash64(text_of(text))}).join(best, [row, hashed], "left_semi")
    copy = F.row_number().over(Window.partitionBy(row, hashed).orderBy(F.lit(0)))
    return marked.withColumn(nth, copy).where(F.col(nth) == 1).select(*docs.columns)
