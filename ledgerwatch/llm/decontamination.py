"""Benchmark decontamination with generalised suffix automata over words.

Test items are lower-cased, cut into words, and built into a generalised suffix automaton: its states are the sets of
places where a run of words occurs in any item. Documents stream through it word by word; the automaton keeps the longest
run ending at the current word that occurs in an item. A run of at least ``WINDOW`` words is a hit as a whole, as every
window inside it stands in an item; an item of fewer words is a hit where all of it occurs, which suffix links tell. The
state that holds the last ``WINDOW`` words of a run knows the items that contain them.

Items are dealt into shards of about ``SHARD_WORDS`` words; each shard's automaton is built in a task, and goes to the
workers by itself, so what is broadcast is bounded however many items there are. Documents pass all shards without a
shuffle, ``SHARDS_A_PASS`` of them between two written tables. Items longer than ``PART_WORDS`` words are cut into
parts that overlap by a window less one word, which keeps every window whole.

Defined results: a null or empty text has no words and no hits; an item without words is no window; items with the same
id count once; an item with a null id makes words hits but is not named; repeated rows are reported each; an empty table
of documents gives no rows, one of items no hits; texts of any length are read whole; other columns are ignored, or kept
by ``decontaminate`` as they are.
"""

from __future__ import annotations

import pickle
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerwatch.llm.common import bounded_batches, shard_count, text_of
from ledgerwatch.session import persist_table

WINDOW = 10
SHARD_WORDS = 500_000
PART_WORDS = 50_000
SHARDS_A_PASS = 4
#: Documents of which more than this share of the words is hit go as a whole.
MAX_COVERAGE = 0.5

_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def normalised(text: str) -> bytes:
    """A-Z lowered, and a blank for every byte outside a word; as long as the text in UTF-8."""
    return text.encode().translate(_WORD_BYTES)


# -- the automaton -----------------------------------------------------------------------


class SuffixAutomaton:
    """A generalised suffix automaton over sequences of numbers."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, link: int, follow: dict[int, int]) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, state: int, symbol: int, target: int) -> int:
        """The state of the strings that are ``state``'s longest and ``symbol``: ``target``, or what is split off it."""
        if self.length[target] == self.length[state] + 1:
            return target
        part = self._state(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = part
        while state >= 0 and self.next[state].get(symbol) == target:
            self.next[state][symbol] = part
            state = self.link[state]
        return part

    def add(self, sequence: list[int]) -> None:
        last = 0
        for symbol in sequence:
            known = self.next[last].get(symbol)
            if known is not None:
                last = self._split(last, symbol, known)
                continue
            new = self._state(self.length[last] + 1, 0, {})
            state = last
            while state >= 0 and symbol not in self.next[state]:
                self.next[state][symbol] = new
                state = self.link[state]
            if state >= 0:
                self.link[new] = self._split(state, symbol, self.next[state][symbol])
            last = new


def build(parts: list[tuple[str | None, list[bytes]]], window: int = WINDOW) -> bytes:
    """The automaton of a shard's (item, words) with the items of its states, as bytes of bounded size."""
    words: dict[bytes, int] = {}
    numbered = [(item, [words.setdefault(w, len(words)) for w in of]) for item, of in parts]
    made = SuffixAutomaton()
    for _, sequence in numbered:
        made.add(sequence)
    n = len(made.link)
    # Suffix links lead to shorter strings: the state of each state's last ``window`` words, if it has so many.
    tail = [-1] * n
    for state in sorted(range(n), key=made.length.__getitem__):
        if made.length[state] >= window:
            tail[state] = state if made.length[made.link[state]] < window else tail[made.link[state]]
    holders, whole = defaultdict(set), defaultdict(set)
    for item, sequence in numbered:
        state = 0
        for k, symbol in enumerate(sequence, 1):
            state = made.next[state][symbol]
            if k >= window:
                holders[tail[state]].add(item)
        if len(sequence) < window:
            whole[state].add(item)
    # The next shorter state along the links, itself included, that is a whole short item.
    short = [-1] * n
    for state in sorted(range(1, n), key=made.length.__getitem__):
        short[state] = state if state in whole else short[made.link[state]]
    moves = [(s * len(words) + symbol, t) for s, follow in enumerate(made.next) for symbol, t in follow.items()]
    keys, targets = (np.array(x, dtype=np.int64) for x in zip(*moves)) if moves else (np.zeros(0, np.int64),) * 2
    least = min((len(s) if len(s) < window else window for _, s in numbered), default=window)
    return pickle.dumps(
        {
            "words": list(words),
            "keys": keys,
            "targets": targets.astype(np.int32),
            "link": np.array(made.link, np.int32),
            "length": np.array(made.length, np.int32),
            "tail": np.array(tail, np.int32),
            "short": np.array(short, np.int32),
            "holders": {s: sorted(x for x in items if x is not None) for s, items in holders.items()},
            "whole": {s: sorted(x for x in items if x is not None) for s, items in whole.items()},
            "least": least,
        }
    )


class Matcher:
    """A shard's automaton in a worker."""

    def __init__(self, packed: bytes, window: int):
        data = pickle.loads(packed)
        self._window = window
        self._words = {w: k for k, w in enumerate(data["words"])}
        self._moves = dict(zip(data["keys"].tolist(), data["targets"].tolist()))
        self._link, self._length, self._tail, self._short = (data[k].tolist() for k in ("link", "length", "tail", "short"))
        self._holders, self._whole, self._least = data["holders"], data["whole"], data["least"]

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Intervals of hit words, overlapping as they are found, as rows (start, stop), and the items that occur."""
        known = np.fromiter((self._words.get(w, -1) for w in words), np.int64, len(words))
        inside = np.r_[False, known >= 0, False]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        intervals: list[tuple[int, int]] = []
        states: set[int] = set()
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            # Shorter runs of words that stand in some item hold no whole window.
            if b - a >= self._least:
                self._walk(known[a:b].tolist(), a, intervals, states)
        items = {x for s in states for x in (self._whole.get(-s, ()) if s < 0 else self._holders[s])}
        return np.array(intervals, dtype=np.int64).reshape(-1, 2), items

    def _walk(self, numbers: list[int], first: int, intervals: list, states: set) -> None:
        """``states`` gets the states of windows, and those of whole short items as negative numbers."""
        moves, link, length, count = self._moves, self._link, self._length, len(self._words)
        state = longest = 0
        for at, symbol in enumerate(numbers, first + 1):
            following = moves.get(state * count + symbol)
            while following is None and state:
                state = link[state]
                longest = length[state]
                following = moves.get(state * count + symbol)
            if following is None:
                continue
            state, longest = following, longest + 1
            covered = longest if longest >= self._window else 0
            if covered:
                states.add(self._tail[state])
            part = self._short[state]
            if part >= 0 and length[part] > longest:
                part = self._short[link[part]]
            while part > 0:
                covered = max(covered, length[part])
                states.add(-part)
                part = self._short[link[part]]
            if covered:
                intervals.append((at - covered, at))


_matchers: dict[str, Matcher] = {}


def _matcher(name: str, packed, window: int) -> Matcher:
    """A worker's matcher for a broadcast, kept for the worker's next tasks; a few at most."""
    if name not in _matchers:
        while len(_matchers) >= SHARDS_A_PASS:
            _matchers.pop(next(iter(_matchers)))
        _matchers[name] = Matcher(packed.value, window)
    return _matchers[name]


# -- items -------------------------------------------------------------------------------


def item_parts(items: DataFrame, window: int = WINDOW, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, words, n_words): the items' words joined by blanks, long items in overlapping parts."""
    bounded_batches(items.sparkSession)
    plain = items.select(F.col(item_id).cast("string").alias("item"), text_of(text).alias("text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, body in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                words = normalised(body).split()
                for k in range(0, max(len(words) - window + 1, min(1, len(words))), PART_WORDS):
                    part = words[k : k + PART_WORDS + window - 1]
                    rows.append((item, b" ".join(part).decode(), len(part)))
            columns = list(zip(*rows)) or [[]] * 3
            kinds = (pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["item", "words", "n_words"])

    return plain.mapInArrow(split, "item string, words string, n_words long")


def automata(items: DataFrame, window: int = WINDOW, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(shard, packed): one automaton per shard of the items, stored."""
    parts = persist_table(item_parts(items, window, item_id, text).distinct(), "items")
    total = parts.agg(F.sum("n_words")).first()[0] or 0
    shards = shard_count(total, SHARD_WORDS)
    dealt = parts.withColumn("shard", F.pmod(F.xxhash64("words", "item"), F.lit(shards)).cast("int"))

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["words", "item"], na_position="first")
        named = [(None if pd.isna(i) else i, w.encode().split()) for i, w in zip(rows["item"], rows["words"])]
        return pd.DataFrame({"shard": [key[0]], "packed": [build(named, window)]})

    return persist_table(dealt.groupBy("shard").applyInPandas(pack, "shard int, packed binary"), "automata")


# -- documents ---------------------------------------------------------------------------


def _names(docs: DataFrame) -> list[str]:
    """Names for the columns of the matching that no column of the documents has."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in ("hit_words", "hit_from", "hit_to", "hit_items"):
        while name in taken:
            name += "_"
        out.append(name)
    return out


def _spans(starts: np.ndarray, stops: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals of ``n`` places, as ascending starts and stops."""
    depth = np.zeros(n + 1, dtype=np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, stops, -1)
    inside = np.r_[False, np.cumsum(depth[:-1]) > 0, False]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def marked(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, list[str]]:
    """The documents with four columns under unused names, which are returned too: the number of words, starts and stops
    of the spans of hit words (word numbers, ascending, disjoint), and the items that occur."""
    spark = docs.sparkSession
    bounded_batches(spark)
    names = _names(docs)
    empty = [F.lit(None).cast("long"), *[F.array().cast("array<int>")] * 2, F.array().cast("array<string>")]
    out = docs.withColumns(dict(zip(names, empty)))
    stored = automata(items, window, item_id, item_text)
    shards = sorted(r.shard for r in stored.select("shard").collect())
    for k, shard in enumerate(shards):
        if k and k % SHARDS_A_PASS == 0:
            out = persist_table(out, "matched")
        # One automaton at a time, of bounded size.
        packed = spark.sparkContext.broadcast(bytes(stored.where(F.col("shard") == shard).first().packed))
        out = out.mapInArrow(_matching(packed, window, text, names), out.schema)
    if not shards:
        out = out.mapInArrow(_matching(None, window, text, names), out.schema)
    return out, names


def _matching(packed, window: int, text: str, names: list[str]):
    name = uuid.uuid4().hex

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, starts, stops, found = [], [], [], []
            before = (batch.column(n) for n in names[1:])
            for body, *so_far in zip(batch.column(text), *before):
                words = normalised(str(body.as_py() or "")).split()
                froms, tos, items = (x.as_py() for x in so_far)
                if packed is not None:
                    new, more = _matcher(name, packed, window).hits(words)
                    if len(new):
                        froms, tos = _spans(np.r_[froms, new[:, 0]].astype(np.int64), np.r_[tos, new[:, 1]].astype(np.int64), len(words))
                        items = sorted({*items, *more})
                sizes.append(len(words))
                starts.append(froms)
                stops.append(tos)
                found.append(items)
            arrays = [pa.array(sizes, pa.int64()), *(pa.array(x, pa.list_(pa.int32())) for x in (starts, stops)), pa.array(found, pa.list_(pa.string()))]
            columns = {n: batch.column(n) for n in batch.schema.names} | dict(zip(names, arrays))
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return match


def overlaps(docs: DataFrame, items: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, spans (start and stop word), items (ids as text, sorted)."""
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    rows, (words, starts, stops, found) = marked(plain, items, window)
    spans = F.arrays_zip(F.col(starts).alias("start"), F.col(stops).alias("stop"))
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda done, s: done + s["stop"] - s["start"])
    return rows.select("doc_id", F.col(words).alias("n_words"), hit.alias("n_hit"), spans.alias("spans"), F.col(found).alias("items"))


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    min_span: int = 1,
    max_coverage: float = MAX_COVERAGE,
    text: str = "text",
) -> DataFrame:
    """The documents without what they share with the items, with all their columns.

    Hit spans of at least ``min_span`` words are cut out, from the first letter of the span to the last; a document of
    whose words more than ``max_coverage`` are hit goes as a whole. A document without hits stays as it is.
    """
    rows, (words, starts, stops, found) = marked(docs, items, window, text)
    spans = F.arrays_zip(F.col(starts).alias("start"), F.col(stops).alias("stop"))
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda done, s: done + s["stop"] - s["start"])
    kept = rows.where(hit <= F.col(words) * F.lit(max_coverage))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body, froms, tos in zip(*(batch.column(n) for n in (text, starts, stops))):
                body = body.as_py()
                spans = [(a, b) for a, b in zip(froms.as_py(), tos.as_py()) if b - a >= min_span]
                out.append(_without(body, spans) if spans else body)
            columns = {n: batch.column(n) for n in batch.schema.names}
            columns[text] = pa.array(out, columns[text].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return kept.mapInArrow(cut, kept.schema).drop(words, starts, stops, found)


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    letters = np.r_[False, np.frombuffer(normalised(text), np.uint8) != 0x20, False]
    edges = np.flatnonzero(letters[1:] != letters[:-1])
    firsts, ends = edges[::2], edges[1::2]
    data, out, at = text.encode(), [], 0
    for a, b in spans:
        out.append(data[at : firsts[a]])
        at = ends[b - 1]
    return b"".join([*out, data[at:]]).decode()
