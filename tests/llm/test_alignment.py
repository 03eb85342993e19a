"""Token alignment against the two libraries and a restatement byte by byte."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerwatch.llm import alignment as module
from ledgerwatch.llm.alignment import Rows, alignment, products, token_links
from ledgerwatch.llm.common import documents

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def spelled():
    letters = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    value = {chr(b): b for b in letters}
    value |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in letters)}
    tokenizer, model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tokenizer.encode_special_tokens = True

    def a(text):
        ids = tokenizer.encode(" " + text, add_special_tokens=False).ids
        return ids, [bytes(value[c] for c in tokenizer.id_to_token(i)) for i in ids]

    def b(text):
        ids = model.encode(text)
        pieces = [model.id_to_piece(i) for i in ids]
        return ids, [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, pieces)]

    return a, b


def restated(rows):
    a_of, b_of = spelled()
    held, docs = Counter(), []
    for doc_id, text in rows:
        ids, groups, links = ([], []), [], []
        if text:
            (a, a_bytes), (b, b_bytes) = a_of(text), b_of(text)
            whole = (" " + text).encode()
            if b"".join(a_bytes) == whole == b"".join(b_bytes):
                ids = (a, b)
                owner_a, owner_b = ([k for k, t in enumerate(side) for _ in t] for side in (a_bytes, b_bytes))
                links = sorted(set(zip(owner_a, owner_b)))
                ends_a, ends_b = (list(np.cumsum([len(t) for t in side])) for side in (a_bytes, b_bytes))
                common = sorted(set(ends_a) & set(ends_b))
                by_a, by_b = defaultdict(list), defaultdict(list)
                for by, ends, side in ((by_a, ends_a, a), (by_b, ends_b, b)):
                    for k, token in zip(np.searchsorted(np.array(common), ends).tolist(), side):
                        by[common[k]].append(token)
                groups = [(by_a[c], by_b[c]) for c in common]
        pairs = [(ids[0][x], ids[1][y]) for x, y in links]
        held.update(set(pairs))
        docs.append((doc_id, ids, groups, pairs))
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    out = Counter()
    for doc_id, (a, b), groups, pairs in docs:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if a else ""
        best = sum(held[p] == most[p[0]] for p in pairs)
        out[(doc_id, len(a), len(b), len(groups), len(pairs), best, sum(held[p] for p in pairs), digest)] += 1
    return out


def found(df):
    return Counter(tuple(r[n] for n in NAMES) for r in alignment(df, A, B).collect())


def test_given_documents(spark, folder):
    df = documents(spark, folder)
    assert found(df) == restated([(r.doc_id, r.text) for r in df.collect()])


def test_odd_rows(docs_of, odd_rows):
    rows = [r for r in odd_rows if r[0] != 11]
    rows += [(20, "▁ marks"), (21, "日本語のテキスト 🙂🙂🙂 naïve café ﬁ Ａ"), (22, "a\x00b"), (23, "<s> </s> <unk> <0x41>"), (24, "   "), (25, "▁")]
    df = docs_of(rows)
    for name in ("block", "pair", "pairs", "times", "n_docs", "is_best", "a_id"):
        df = df.withColumn(name, F.lit("x"))
    assert found(df) == restated([(r[0], r[1]) for r in rows])


def test_very_long_text_and_blocks(spark, docs_of, monkeypatch):
    rng = random.Random(3)
    words = ["alpha", "Beta,", "gamma7", "délta", "42", "日本", "x"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(30_000 if k == 3 else 40))) for k in range(60)]
    assert found(docs_of(rows).repartition(3)) == restated(rows)


def test_empty_table(docs_of):
    assert alignment(docs_of([]), A, B).count() == 0


def test_links_of_both_kinds(docs_of):
    rows = [(1, "unbelievable tokenizers 🙂 misaligned"), (2, None), (3, "Overlapping boundaries")]
    df = docs_of(rows)
    a_of, b_of = spelled()
    for groups in (False, True):
        expected = Counter()
        for doc_id, text in rows:
            if not text:
                continue
            (a, a_bytes), (b, b_bytes) = a_of(text), b_of(text)
            a_end, b_end = ([0, *np.cumsum([len(t) for t in side])] for side in (a_bytes, b_bytes))
            common = sorted(set(a_end[1:]) & set(b_end[1:]))
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    if groups:
                        weight = int(min(c for c in common if c >= a_end[i + 1]) == min(c for c in common if c >= b_end[j + 1]))
                    else:
                        weight = max(0, min(a_end[i + 1], b_end[j + 1]) - max(a_end[i], b_end[j]))
                    if weight:
                        expected[(doc_id, i, j, x, y, int(weight))] += 1
        links = token_links(df, A, B, groups).select("doc_id", "a_at", "b_at", "a_id", "b_id", "weight")
        assert Counter(map(tuple, links.collect())) == expected
    counted = {r.doc_id: r.n_group_links for r in alignment(df, A, B).collect()}
    listed = Counter(r.doc_id for r in token_links(df, A, B, True).collect())
    assert {k: v for k, v in counted.items() if v} == dict(listed)


@pytest.mark.parametrize("bound", [1, 7, 1000])
def test_products_equal_dense_ones(monkeypatch, bound):
    monkeypatch.setattr(module, "_PRODUCTS", bound)
    rng = np.random.default_rng(1)
    for _ in range(20):
        n, k, m = rng.integers(1, 12, 3)
        dense = [(rng.random(s) < 0.3).astype(np.int64) for s in ((n, k), (m, k))]
        a, b = (Rows(np.r_[0, np.cumsum(d.sum(axis=1))], np.nonzero(d)[1], d.shape[1]) for d in dense)
        out = np.zeros((n, m), dtype=np.int64)
        for rows, columns, values in products(a, b.transposed()):
            assert not out[rows, columns].any()
            out[rows, columns] = values
        assert (out == dense[0] @ dense[1].T).all()
