"""Packing documents into sequences of a fixed length: dominance reduction, then best fit.

A document becomes pieces of at most ``length`` tokens. How many pieces have which size is all that packing needs to
know: at most ``length`` numbers, whatever the corpus. On these numbers, Martello and Toth's reduction first fixes sets
of up to three pieces that no other filling of a sequence beats, until none is left; the rest is packed by best fit, the
largest first, many equal sequences at a time. The plan says which ranks within a size go to which sequences, and every
piece finds its place by its rank. Ranks are counted in parts of a size, so a size may hold any share of all pieces.

Defined results: a null or empty text is the end mark alone; repeated rows and ids are packed each; rows with a null id
too; an empty table gives no rows; a text of any length is cut, never shortened; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ledgerwatch.llm.bpe import merger
from ledgerwatch.llm.common import bounded_batches, text_of
from ledgerwatch.session import persist_table

LENGTH = 1024
#: Fixed value: the id that ends a document.
END_ID = 2
ROWS_PER_PART = 50_000


# -- pieces ------------------------------------------------------------------------------


def bounds(total: int, length: int) -> list[tuple[int, int]]:
    """(start, size) of the pieces of a document: whole ones, after a shorter first one if they do not come out even."""
    first = total % length or min(total, length)
    return [(0, first)] + [(start, length) for start in range(first, total, length)]


def pieces(docs: DataFrame, vocabulary: str, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""
    bounded_batches(docs.sparkSession)
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            names = batch.column("doc_id").to_pylist()
            for name, ids in zip(names, merger(vocabulary).ids(batch.column("text").to_pylist())):
                ids = np.append(ids, END_ID).astype("<u4")
                for k, (start, size) in enumerate(bounds(len(ids), length)):
                    rows.append((name, k, start, size, zlib.crc32(ids[start : start + size].tobytes())))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*rows)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return plain.mapInArrow(split, "doc_id long, piece int, start long, length long, ids_crc32 long")


# -- the plan over sizes -----------------------------------------------------------------


def _best_pair(sizes: list[int], left: Counter, room: int) -> tuple[int, int] | None:
    """The two pieces, larger first, with the largest sum that fits in ``room``."""
    best, found, low = 0, None, 0
    high = len(sizes) - 1
    while low <= high:
        a, b = sizes[high], sizes[low]
        if a + b > room:
            high -= 1
        else:
            if (low < high or left[a] > 1) and a + b > best:
                best, found = a + b, (a, b)
            low += 1
    return found


def _dominating(size: int, left: Counter, length: int) -> tuple[int, ...] | None:
    """A set with a piece of ``size`` that some best packing contains, if one of the known reasons shows it."""
    rest = left.copy()
    rest[size] -= 1
    room = length - size
    sizes = sorted(s for s, n in rest.items() if n > 0)
    smallest = [s for s in sizes[:3] for _ in range(min(3, rest[s]))][:3]
    if not smallest or smallest[0] > room:
        return (size,)
    single = max(s for s in sizes if s <= room)
    # A full pair, or no room for two: whatever stands beside the piece fits where the largest single came from.
    if single == room or sum(smallest[:2]) > room or len(smallest) < 2:
        return (size, single)
    if len(smallest) == 3 and sum(smallest) <= room:
        return None
    pair = _best_pair([s for s in sizes if s <= room], rest, room)
    if pair is None or single >= sum(pair):
        return (size, single)
    # The best pair beats any other if it has the largest single, and no two pieces above its second fit together.
    above = [s for s in sizes if s > pair[1]][:2]
    above = [s for s in above for _ in range(min(2, rest[s]))][:2]
    if pair[0] == single and (len(above) < 2 or sum(above) > room):
        return (size, *pair)
    return None


def reduce_sizes(counts: dict[int, int], length: int) -> tuple[list[tuple[tuple[int, ...], int]], Counter]:
    """Fixed sets with how often each is taken, and what is left of the sizes."""
    left = Counter({s: n for s, n in counts.items() if n > 0})
    fixed: list[tuple[tuple[int, ...], int]] = []
    again = True
    while again:
        again = False
        for size in sorted(left, reverse=True):
            while left[size] > 0 and (chosen := _dominating(size, left, length)):
                # The reasons hold as long as the chosen sizes last: taking pieces away makes no other set better.
                times = min(left[s] // n for s, n in Counter(chosen).items())
                for s in chosen:
                    left[s] -= times
                fixed.append((chosen, times))
                again = True
        left = +left
    return fixed, left


def best_fit(left: Counter, length: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, the largest first; equal sequences are kept as one entry with their number."""
    open_: dict[int, list[list]] = {}
    for size in sorted(left, reverse=True):
        n = left[size]
        while n > 0:
            room = min((r for r in open_ if r >= size), default=None)
            if room is None:
                whole, rest = divmod(n, length // size)
                filled = [(length // size, whole), (rest, 1)]
                for k, times in filled:
                    if k and times:
                        open_.setdefault(length - k * size, []).append([(size,) * k, times])
                break
            entry = open_[room][-1]
            times = min(n, entry[1])
            entry[1] -= times
            if not entry[1]:
                open_[room].pop()
                if not open_[room]:
                    del open_[room]
            open_.setdefault(room - size, []).append([(*entry[0], size), times])
            n -= times
    return [(tuple(sizes), times) for entries in open_.values() for sizes, times in entries]


def plan(counts: dict[int, int], length: int = LENGTH) -> pd.DataFrame:
    """Runs of ranks: pieces ``rank .. rank + n - 1`` of a size go to the sequences from ``sequence`` on, ``each`` to one, from ``offset``."""
    fixed, left = reduce_sizes(counts, length)
    used, sequence, runs = Counter(), 0, []
    for sizes, times in [*fixed, *best_fit(left, length)]:
        offset = 0
        for size, each in sorted(Counter(sizes).items(), reverse=True):
            runs.append((size, used[size], times * each, sequence, each, offset))
            used[size] += times * each
            offset += size * each
        sequence += times
    return pd.DataFrame(runs, columns=["length", "rank", "n", "sequence", "each", "offset"]).sort_values(["length", "rank"])


# -- packing -----------------------------------------------------------------------------


def place(cut: DataFrame, length: int = LENGTH) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to the pieces, which must be a stored table."""
    counts = {row["length"]: row["n"] for row in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = plan(counts, length)
    # At most ``length`` rows.
    cuts = [(size, -(-n // ROWS_PER_PART)) for size, n in counts.items()]
    cuts = F.broadcast(cut.sparkSession.createDataFrame(cuts, "length long, _parts long"))
    salted = cut.join(cuts, "length").withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("_parts")))
    salted = salted.drop("_parts")
    per_part = salted.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = per_part.select("length", "_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_first"))
    within = Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = salted.withColumn("_rank", F.row_number().over(within) - 1).join(firsts, ["length", "_part"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_first")).drop("_part", "_first")

    by_size = {size: part.to_numpy(dtype=np.int64) for size, part in runs.groupby("length")} if len(runs) else {}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ranks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            sequence, offset = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
            for size in np.unique(sizes):
                rows, mine = by_size[size], sizes == size
                run = rows[np.searchsorted(rows[:, 1], ranks[mine], side="right") - 1]
                nth = ranks[mine] - run[:, 1]
                sequence[mine] = run[:, 3] + nth // run[:, 4]
                offset[mine] = run[:, 5] + nth % run[:, 4] * size
            columns = [batch.column(c) for c in names] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select(*names, "_rank").mapInArrow(assign, schema)


def pack(docs: DataFrame, vocabulary: str, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = persist_table(pieces(docs, vocabulary, length, doc_id, text), "pieces")
    return place(cut, length)
