"""Decontamination against a restatement with sets of windows, and the automaton against all runs of words."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerwatch.llm import decontamination as module
from ledgerwatch.llm.common import documents
from ledgerwatch.llm.decontamination import SuffixAutomaton, decontaminate, overlaps

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEM = "item_id long, text string"


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def restated(docs, items, window=10):
    windows = {}
    for item, text in items:
        words = words_of(text)
        size = min(window, len(words))
        for k in range(len(words) - size + 1) if words else ():
            windows.setdefault(tuple(words[k : k + size]), set()).add(item)
    sizes = sorted({len(w) for w in windows})
    out = Counter()
    for doc_id, text in docs:
        words = words_of(text)
        hit, of = set(), set()
        for size in sizes:
            for k in range(len(words) - size + 1):
                held = windows.get(tuple(words[k : k + size]))
                if held is not None:
                    hit.update(range(k, k + size))
                    of.update(held)
        named = sorted(str(x) for x in of if x is not None)
        out[(doc_id, len(words), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest())] += 1
    return out


def found(df, items, window=10):
    rows = overlaps(df, items, window).collect()
    for r in rows:
        assert sum(s.stop - s.start for s in r["spans"]) == r.n_hit
        assert all(a.stop < b.start for a, b in zip(r["spans"], r["spans"][1:]))
    return Counter((r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest()) for r in rows)


def test_given_tables(spark, folder):
    df, items = documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet")
    expected = restated([(r.doc_id, r.text) for r in df.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert any(k[2] for k in expected) and found(df, items) == expected


def made(seed, n_items=60, n_docs=120, letters=3):
    """Texts of few different words, so that runs of all lengths occur, with items planted whole and in part."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdef"[:letters])
    items = [(rng.randrange(40), " ".join(word() for _ in range(rng.choice([1, 3, 5, 9, 10, 11, 15, 40])))) for _ in range(n_items)]
    items = [(i, t) for i, t in items if len(t) > 5] + [(None, "q r s t u"), (77, None), (78, " .,! "), (79, "é È ñ")]
    docs = []
    for k in range(n_docs):
        words = [word() if rng.random() < 0.9 else "zz" for _ in range(rng.randrange(60))]
        if rng.random() < 0.5:
            part = rng.choice(items)[1] or ""
            part = part.split()[rng.randrange(3) :]
            words[5:5] = part
        docs.append((k, (", " if k % 2 else " ").join(words).upper() if k % 3 else " ".join(words)))
    return docs, items


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("shard", [500_000, 400])
def test_random_texts(spark, docs_of, monkeypatch, seed, shard):
    """Also in many shards, with items cut into parts."""
    monkeypatch.setattr(module, "SHARD_WORDS", shard)
    if shard == 400:
        monkeypatch.setattr(module, "PART_WORDS", 7)
    docs, items = made(seed, letters=2 + seed)
    assert found(docs_of(docs), spark.createDataFrame(items, ITEM)) == restated(docs, items)


def test_odd_rows(spark, docs_of, odd_rows):
    items = [(1, "two words and more text"), (1, "two words and more text"), (None, "alpha"), (2, ""), (3, None), (4, odd_rows[14][1]), (5, "x" * 20_000)]
    long_item = next(r[1] for r in odd_rows if r[0] == 11)
    items.append((6, long_item))
    df = docs_of(odd_rows)
    for name in ("hit_words", "hit_from", "hit_to", "hit_items", "HIT_ITEMS_", "item", "n_hit", "spans"):
        df = df.withColumn(name, F.lit("x"))
    assert found(df, spark.createDataFrame(items, ITEM)) == restated([r[:2] for r in odd_rows], items)
    kept = decontaminate(df, spark.createDataFrame(items, ITEM), max_coverage=1.0)
    assert kept.columns == df.columns and kept.count() == df.count()
    assert {r.hit_items for r in kept.collect()} == {"x"}


def test_empty_tables(spark, docs_of):
    docs = [(1, "some words"), (2, None)]
    assert found(docs_of(docs), spark.createDataFrame([], ITEM)) == restated(docs, [])
    assert found(docs_of([]), spark.createDataFrame([(1, "some words")], ITEM)) == Counter()
    kept = decontaminate(docs_of(docs), spark.createDataFrame([], ITEM))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == docs


def test_spans_and_coverage(spark, docs_of):
    item = "One two, three four five six seven eight nine TEN eleven"
    long = "Start here. " + "clean words stand here " * 10
    docs = [
        (1, long + "(one TWO three four five six seven eight nine ten!) End."),
        (2, "before " + item),
        (3, long),
        (4, long + "short hit. " + item),
    ]
    items = spark.createDataFrame([(1, item), (2, "short hit")], ITEM)
    kept = {r.doc_id: r.text for r in decontaminate(docs_of(docs), items).collect()}
    assert kept == {1: long + "(!) End.", 3: long, 4: long}
    kept = {r.doc_id: r.text for r in decontaminate(docs_of(docs), items, min_span=3, max_coverage=1.0).collect()}
    assert kept[2] == "before " and kept[4] == long  # one span, as the two stand side by side
    kept = {r.doc_id: r.text for r in decontaminate(docs_of([(5, "a short hit only b")]), items, min_span=3, max_coverage=1.0).collect()}
    assert kept == {5: "a short hit only b"}


def test_automaton_holds_all_runs_and_no_others():
    rng = random.Random(2)
    for _ in range(50):
        sequences = [[rng.randrange(3) for _ in range(rng.randrange(1, 12))] for _ in range(5)]
        made = SuffixAutomaton()
        for s in sequences:
            made.add(s)
        runs = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}

        def walk(run):
            state = 0
            for x in run:
                state = made.next[state].get(x)
                if state is None:
                    return None
            return state

        assert all(walk(r) is not None for r in runs)
        for _ in range(200):
            run = tuple(rng.randrange(3) for _ in range(rng.randrange(1, 8)))
            assert (walk(run) is not None) == (run in runs)
        # Every run has the state whose lengths it falls into.
        for r in runs:
            state = walk(r)
            assert made.length[made.link[state]] < len(r) <= made.length[state]
        assert len(made.link) <= 2 * sum(map(len, sequences)) + 1
