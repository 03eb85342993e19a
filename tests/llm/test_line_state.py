"""A state of lines that grows and shrinks batch by batch: the same as one built at once, and what a change writes."""

import random
import time
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pytest

from ledgerwatch.llm import line_dedup

LINE = "A line of text that is surely longer than forty characters, number "


def _docs(docs_of, ids, seed=0):
    rng = random.Random(seed)
    return docs_of([(i, "\n".join(f"{LINE}{rng.randrange(40)}" for _ in range(4))) for i in ids], extra=False)


def _cleaned(state, docs):
    return sorted(map(tuple, line_dedup.clean(state, docs).collect()))


def _counts(state):
    return sorted((bytes(r.key), r.n_docs, r.keeper) for r in state.counts.collect())


def _held(state):
    """Shards and keys on which the filters answer."""
    filters = {r["shard"]: line_dedup._filter(r) for r in state.filters.collect()}
    often = state.repeated.collect()
    return all(filters[r.shard].contains(line_dedup._words([r.key]))[0] for r in often)


@pytest.mark.parametrize("parts", [2, 100])
def test_batches_equal_one_build(docs_of, monkeypatch, parts):
    monkeypatch.setattr(line_dedup, "PARTS", parts)
    batches = [_docs(docs_of, range(k * 10, k * 10 + 10), k) for k in range(4)]
    state = line_dedup.start(batches[0], keys_per_shard=10)
    for batch in batches[1:]:
        state = line_dedup.insert(state, batch)
    everything = batches[0].unionByName(batches[1]).unionByName(batches[2]).unionByName(batches[3])
    assert _cleaned(state, everything) == _cleaned(line_dedup.start(everything), everything)
    assert _counts(state) == _counts(line_dedup.start(everything)) and _held(state)
    # A batch that is inserted again changes nothing.
    again = line_dedup.insert(state, batches[1])
    assert _counts(again) == _counts(state)
    # What is deleted is gone, and can come back.
    less = line_dedup.delete(state, everything.where("doc_id % 3 = 0"))
    rest = everything.where("doc_id % 3 <> 0")
    assert _counts(less) == _counts(line_dedup.start(rest)) and _held(less)
    assert _cleaned(less, rest) == _cleaned(line_dedup.start(rest), rest)
    back = line_dedup.insert(less, everything.where("doc_id % 3 = 0"))
    assert _counts(back) == _counts(state) and _cleaned(back, everything) == _cleaned(state, everything)


def test_some_documents_are_cleaned_alone(docs_of):
    docs = _docs(docs_of, range(30))
    state = line_dedup.start(docs)
    some = docs.where("doc_id < 5")
    assert _cleaned(state, some) == [r for r in _cleaned(state, docs) if r[0] < 5]


def test_shards_split(docs_of):
    docs = docs_of([(i, f"{LINE}{i}") for i in range(200)], extra=False)
    state = line_dedup.start(docs.where("doc_id < 2"), keys_per_shard=20)
    grown = line_dedup.folded(line_dedup.insert(state, docs.where("doc_id >= 2")))
    assert state.shards == 2 and grown.shards == 5
    assert {r.shard for r in grown.counts.collect()} == set(range(5))
    assert _cleaned(grown, docs) == _cleaned(state, docs)


def test_null_ids_and_empty_batches(docs_of):
    rows = [(None, f"{LINE}1"), (None, f"{LINE}1"), (1, f"{LINE}1"), (2, None)]
    state = line_dedup.start(docs_of(rows[:0], extra=False), min_docs=2)
    state = line_dedup.insert(state, docs_of(rows, extra=False))
    state = line_dedup.insert(state, docs_of([], extra=False))
    assert [(r.n_docs, r.keeper) for r in state.counts.collect()] == [(2, 1)]
    cleaned = line_dedup.clean(state, docs_of(rows, extra=False)).collect()
    assert sorted((r.doc_id or 0, r.kept_text) for r in cleaned) == [(0, ""), (0, ""), (1, f"{LINE}1"), (2, "")]


def _written(df):
    return sum(p.stat().st_size for f in df.inputFiles() for p in [Path(urlparse(f).path)])


def test_a_change_writes_its_own(docs_of):
    small = docs_of([(10**6, f"{LINE}0")], extra=False)
    sizes = []
    for n in (20, 2000):
        state = line_dedup.insert(line_dedup.start(docs_of([(i, f"{LINE}{i}") for i in range(n)], extra=False)), small)
        sizes.append(sum(_written(parts[-1]) for parts in (state.added, state.counted, state.filtered)))
    assert sizes[1] < 1.2 * sizes[0]


def test_many_keys_into_a_small_filter(spark):
    """A filter without room is not filled by moves: it is built anew from the exact keys, in seconds."""
    keys = np.random.default_rng(3).integers(0, 2**62, (200_000, 2)).astype("<u8")
    held = line_dedup.CuckooFilter.sized(4)
    held.insert(keys[:2])
    old = spark.createDataFrame(line_dedup._row(0, held).assign(version=1), f"{line_dedup._FILTER}, version int")
    rows = pd.DataFrame({"shard": 0, "key": [k.tobytes() for k in keys]})
    every = spark.createDataFrame(rows, "shard int, key binary")
    moved = spark.createDataFrame(rows[2:].assign(add=True), "shard int, key binary, add boolean")
    state = line_dedup.LineState((), (), (), (old,), 1)
    begin = time.monotonic()
    (row,) = line_dedup._changed_filters(state, moved, every).collect()
    assert time.monotonic() - begin < 30
    made = line_dedup._filter(row.asDict())
    assert made.contains(keys).all() and not made.rest and not made.crowded()
