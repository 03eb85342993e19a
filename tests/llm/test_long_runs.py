"""Long runs without a place to cut: the same ids as the library, in time that grows with the length alone."""

import random
import time

import numpy as np
import pytest
import tokenizers

from ledgerwatch.llm.bpe import PairMerger
from ledgerwatch.llm.queries import vocabulary


@pytest.fixture(scope="module")
def both():
    return PairMerger(vocabulary()), tokenizers.Tokenizer.from_file(vocabulary())


def _letters(alphabet, n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice(alphabet) for _ in range(n))


LOWER, BASE64 = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
RUNS = [
    "a" * 5000,
    "ab" * 3001,
    "-" * 1000 + "=" * 999,
    "abcabcd" * 700,
    "é" * 3000,
    "漢字" * 1500,
    " " * 3000 + "x" + "\n" * 700,
    "the" * 257 + "cat" * 300,
    *[_letters(LOWER, n, n) for n in (255, 256, 257, 258, 300, 320, 321, 5000)],
    *[_letters(BASE64, n, n) for n in (257, 4097, 30_000)],
    _letters("aeiouäöüßñ", 6000, 1),
    _letters("漢字学校日本語", 4000, 2),
    _letters("aab", 9000, 3),
    _letters("!?.,-", 4000, 4),
    _letters("0123456789", 4000, 5),
]


def test_ids_of_runs(both):
    own, library = both
    for text, ids in zip(RUNS, own.ids(RUNS)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text[:40]


def test_many_runs_at_once(both):
    own, library = both
    rng = random.Random(9)
    texts = [" ".join(_letters(rng.choice([LOWER, "ab", BASE64, "x"]), rng.randrange(1, 1500), k * 50 + j) for j in range(5)) for k in range(60)]
    assert [x.tolist() for x in own.ids(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_time_of_a_long_run(both):
    own, library = both
    text = _letters(LOWER, 400_000, 11)
    own.count(["warm"])
    begin = time.monotonic()
    (n,) = own.count([text])
    # Two seconds on an idle machine, where one round per pair took a minute and a half.
    assert time.monotonic() - begin < 10
    assert n == len(library.encode(text, add_special_tokens=False).ids)


def test_two_special_strings(both):
    own = PairMerger(vocabulary())
    own.special = {"<a>": 7, "<a><b>": 8, "<b>": 9}
    texts = ["<b>x<a><b>y<a>", "<a>", "", "none"]
    x, y, none = (i.tolist() for i in own.ids(["x", "y", "none"]))
    assert [i.tolist() for i in own.ids(texts)] == [[9, *x, 8, *y, 7], [7], [], none]
    assert own.count(texts).tolist() == [3 + len(x) + len(y), 1, 0, len(none)]
    assert np.array_equal(own.count(texts), [len(i) for i in own.ids(texts)])
