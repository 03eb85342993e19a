"""Byte-level pair merging over ragged numpy arrays, for many texts at once.

A batch of texts becomes one array of code points. Array operations cut it into pre-tokens as the vocabulary's pattern
does; equal pre-tokens are found by a rolling 64-bit hash, and each distinct one is merged once. All distinct
pre-tokens of a batch are merged together: in every round each sequence applies its own lowest-ranked pair at all its
places, and sequences without a pair that can merge leave the arrays.

A long sequence would need a round for nearly each of its pairs. It is merged in short windows that overlap by half, all
windows in the same rounds. Where two neighbours have a token in common, the tokens of the first up to it are followed by
those of the second behind it. That is exact: whether two tokens that follow each other stay apart depends on these two
alone, and each two of the result follow each other in one of the windows. Sequences with an overlap without a common
token, as in a run of one letter, are tried again in longer windows and at last as a whole.

Defined results: an empty text has no ids; characters that Unicode leaves unassigned are neither letters, numbers nor white
space; special strings in texts are one id each, the leftmost first and of those that start together the longest.
"""

from __future__ import annotations

import functools
import json
import re
import sys
import unicodedata

import numpy as np

_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3
# The characters with the Unicode property White_Space.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# What may follow an apostrophe within one pre-token.
_ENDINGS = ["s", "t", "m", "d", "re", "ve", "ll"]

_NONE = np.int64(1) << 40
#: Code points handled at once; more only for a single text that is longer.
CHUNK = 1_000_000
#: A worker remembers pre-tokens in this many places, one each, and up to this many ids for them.
PLACES = 1 << 19
REMEMBERED_IDS = 3_000_000
#: Bytes of the windows in which sequences of more than ``LONG`` windows are merged, and bytes merged at once in them.
WINDOWS = (64, 1024)
LONG = 4
_BYTES_AT_ONCE = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


@functools.lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    kinds = {"L": _LETTER, "N": _NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(sys.maxunicode + 1)), np.uint8)
    table[_WHITE] = _SPACE
    return table


@functools.lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse modulo 2^64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(size + 1, base, dtype=np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def cut(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in ``points``, which holds texts that start at ``firsts``."""
    n = len(points)
    kind = _classes()[points]
    begins = np.zeros(n + 1, dtype=bool)
    begins[firsts] = True
    begins[n] = True
    runs = begins[:n].copy()
    runs[1:] |= kind[1:] != kind[:-1]
    starts = runs.copy()
    # The last white space before a word stands alone, or joins the word if it is a blank.
    after = np.flatnonzero(runs[1:] & ~begins[1:n] & (kind[:-1] == _SPACE)) + 1
    starts[after - 1] = True
    starts[after[points[after - 1] == 0x20]] = False
    # Endings after an apostrophe that is a run of its own and has not joined a blank.
    marks = np.flatnonzero((points == 0x27) & starts & runs)
    marks = marks[marks + 1 < n]
    marks = marks[(kind[marks + 1] == _LETTER) & ~begins[marks + 1]]
    for ending in _ENDINGS:
        size = len(ending)
        at = marks[marks + size < n]
        for k, letter in enumerate(ending, 1):
            at = at[(points[at + k] == ord(letter)) & ~begins[at + k]]
        starts[at + 1] = False
        rest = at + 1 + size
        starts[rest[rest < n]] = True
    return np.flatnonzero(starts)


def _pieces(data: np.ndarray, firsts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Pieces of ``data`` one after another."""
    upto = np.cumsum(sizes)
    return data[np.repeat(firsts - (upto - sizes), sizes) + np.arange(int(upto[-1]) if len(upto) else 0)]


class _PairTable:
    """Pairs of ids to their rank. A pair stands at one of two places, or in a short sorted rest."""

    _BITS = 18

    def __init__(self, keys: np.ndarray):
        size = 1 << self._BITS
        self._held = [np.full(size, -1, dtype=np.int64) for _ in range(2)]
        self._rank = [np.full(size, _NONE, dtype=np.int64) for _ in range(2)]
        left = np.arange(len(keys))
        for k in range(2):
            at = self._place(keys[left], k)
            _, first = np.unique(at, return_index=True)
            self._held[k][at[first]], self._rank[k][at[first]] = keys[left[first]], left[first]
            left = np.delete(left, first)
        order = left[np.argsort(keys[left])]
        self._rest, self._rest_rank = np.r_[keys[order], np.iinfo(np.int64).max], np.r_[order, _NONE]

    def _place(self, keys: np.ndarray, k: int) -> np.ndarray:
        factor = np.uint64((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)[k])
        return ((keys.astype(np.uint64) * factor) >> np.uint64(64 - self._BITS)).astype(np.int64)

    def ranks(self, keys: np.ndarray) -> np.ndarray:
        at = self._place(keys, 0)
        out = np.where(self._held[0][at] == keys, self._rank[0][at], _NONE)
        open_ = np.flatnonzero(out == _NONE)
        keys = keys[open_]
        at = self._place(keys, 1)
        second = np.where(self._held[1][at] == keys, self._rank[1][at], _NONE)
        if len(self._rest) > 1:
            at = np.searchsorted(self._rest, keys)
            second = np.where(self._rest[at] == keys, self._rest_rank[at], second)
        out[open_] = second
        return out


class PairMerger:
    """One vocabulary of a ``.json`` file, with the pre-tokens merged lately."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        vocab = model["model"]["vocab"]
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["model"]["merges"]]
        self._table = _PairTable(np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64))
        self._merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self._bytes = np.array([vocab[x] for x in byte_letters()], dtype=np.int64)
        self._widths = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
        for entry, number in vocab.items():
            self._widths[number] = len(entry)
        #: Strings that are one token wherever they stand.
        self.special = {x["content"]: x["id"] for x in model["added_tokens"]}
        self._forget()

    def _forget(self) -> None:
        self._known = np.zeros(PLACES, dtype=np.uint64)
        self._entry = np.full(PLACES, -1, dtype=np.int64)
        self._lengths = np.zeros(0, dtype=np.int64)
        self._firsts = np.zeros(0, dtype=np.int64)
        self._pool = np.zeros(0, dtype=np.uint32)

    # -- merging ---------------------------------------------------------------------

    def merge(self, data: np.ndarray, sizes: np.ndarray, windows: tuple[int, ...] = WINDOWS) -> tuple[np.ndarray, np.ndarray]:
        """Ids of sequences of bytes, which stand in ``data`` one after another and are not empty, and their lengths."""
        long = sizes > LONG * windows[0] if windows else np.zeros(len(sizes), dtype=bool)
        if not long.any():
            return self._merge_whole(data, sizes)
        firsts = np.cumsum(sizes) - sizes
        at = np.flatnonzero(long)
        of, ids, whole = self._merge_long(data, firsts[at], sizes[at], windows[0])
        owners, found = [at[of]], [ids]
        short, rest = np.flatnonzero(~long), at[~whole]
        for some, merge in ((short, self._merge_whole), (rest, functools.partial(self.merge, windows=windows[1:]))):
            ids, counts = merge(_pieces(data, firsts[some], sizes[some]), sizes[some])
            owners.append(np.repeat(some, counts))
            found.append(ids)
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return np.concatenate(found)[order], np.bincount(owner, minlength=len(sizes))

    def _merge_long(self, data: np.ndarray, firsts: np.ndarray, sizes: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
        """The sequence of each id, the ids, and which sequences have come out whole; of the others there are no ids."""
        step = span // 2
        count = -(-(sizes - span) // step) + 1
        of = np.repeat(np.arange(len(sizes)), count)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        start = firsts[of] + nth * step
        width = np.minimum(span, firsts[of] + sizes[of] - start)
        parts = []
        for a in range(0, len(of), max(1, _BYTES_AT_ONCE // span)):
            part = slice(a, a + max(1, _BYTES_AT_ONCE // span))
            parts.append(self._merge_whole(_pieces(data, start[part], width[part]), width[part]))
        ids, tokens = (np.concatenate(x) for x in zip(*parts))
        window = np.repeat(np.arange(len(of)), tokens)
        size = self._widths[ids]
        end = np.cumsum(size) + (start - (np.cumsum(width) - width))[window]
        begin = end - size
        first, last = nth == 0, nth == count[of] - 1
        # A window's second half is the first half of the next one.
        middle = start + step
        key = begin * (span + 1) + size
        leaving = np.flatnonzero((begin >= middle[window]) & ~last[window])
        coming = np.flatnonzero((end <= middle[window]) & ~first[window])
        common = leaving[np.isin(key[leaving], key[coming], assume_unique=True)]
        held, example = np.unique(window[common], return_index=True)
        upto = np.where(last, start + width, -1)
        upto[held] = end[common[example]]
        since = np.where(first, start, np.r_[0, upto[:-1]])
        whole = np.bincount(of[upto < 0], minlength=len(sizes)) == 0
        taken = np.flatnonzero(whole[of[window]] & (begin >= since[window]) & (end <= upto[window]))
        return of[window[taken]], ids[taken], whole

    def _merge_whole(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        symbols = self._bytes[data]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        done_owner, done_symbols = [], []
        while len(symbols):
            rank = np.full(len(symbols), _NONE)
            inner = np.flatnonzero(owner[:-1] == owner[1:])
            rank[inner] = self._table.ranks(symbols[inner] << 32 | symbols[inner + 1])
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(symbols)]))
            over = lowest == _NONE
            if over.any():
                done_owner.append(owner[over])
                done_symbols.append(symbols[over])
                going = ~over
                symbols, owner, rank, lowest = symbols[going], owner[going], rank[going], lowest[going]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == lowest)
            # Of overlapping places, as in a run of one letter, every second one from the left.
            new_run = np.r_[True, np.diff(at) != 1]
            run_first = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run_first) % 2 == 0]
            symbols[at] = self._merged[rank[at]]
            left = np.ones(len(symbols), dtype=bool)
            left[at + 1] = False
            symbols, owner = symbols[left], owner[left]
        owner = np.concatenate(done_owner) if done_owner else np.zeros(0, dtype=np.int64)
        symbols = np.concatenate(done_symbols) if done_symbols else np.zeros(0, dtype=np.int64)
        order = np.argsort(owner, kind="stable")
        return symbols[order].astype(np.uint32), np.bincount(owner, minlength=len(sizes))

    def _entries(self, hashes: np.ndarray, spelled) -> np.ndarray:
        """For each pre-token its place among the remembered ones; ``spelled`` gives the bytes of those at some indices."""
        if len(self._pool) > REMEMBERED_IDS:
            self._forget()
        at = (hashes >> np.uint64(64 - PLACES.bit_length() + 1)).astype(np.int64)
        found = np.where(self._known[at] == hashes, self._entry[at], -1)
        new = np.flatnonzero(found < 0)
        if len(new):
            _, example, each = np.unique(hashes[new], return_index=True, return_inverse=True)
            example = new[example]
            ids, sizes = self.merge(*spelled(example))
            entries = len(self._lengths) + np.arange(len(example))
            self._firsts = np.r_[self._firsts, len(self._pool) + np.cumsum(sizes) - sizes]
            self._lengths = np.r_[self._lengths, sizes]
            self._pool = np.r_[self._pool, ids]
            self._known[at[example]], self._entry[at[example]] = hashes[example], entries
            found[new] = entries[each]
        return found

    def _chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per pre-token its text and its entry."""
        joined = "".join(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        firsts = np.cumsum(sizes) - sizes
        starts = cut(points, firsts[sizes > 0])
        ends = np.r_[starts[1:], len(points)]
        up, down = _powers(max(CHUNK, 1 << int(len(points)).bit_length()))
        x = points.astype(np.uint64) + np.uint64(1)
        x = (x ^ (x << np.uint64(21))) * np.uint64(0xBF58476D1CE4E5B9)
        sums = np.r_[np.uint64(0), np.cumsum((x ^ (x >> np.uint64(31))) * up[: len(x)], dtype=np.uint64)]
        hashes = (sums[ends] - sums[starts]) * down[starts]
        hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)

        def spelled(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            data = np.frombuffer(joined.encode(), dtype=np.uint8)
            widths = np.ones(len(points), dtype=np.int64) + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
            place = np.r_[0, np.cumsum(widths)]
            a, b = place[starts[some]], place[ends[some]]
            return _pieces(data, a, b - a), b - a

        return np.searchsorted(firsts, starts, side="right") - 1, self._entries(hashes, spelled)

    # -- texts -----------------------------------------------------------------------

    def _parts(self, texts: list[str]):
        """Texts cut at special strings: (parts, text of each part, special id after the part or -1)."""
        parts, owner, after = [], [], []
        marks = sorted(self.special, key=len, reverse=True)
        pattern = re.compile("(" + "|".join(map(re.escape, marks)) + ")") if marks else None
        for i, text in enumerate(texts):
            pieces = pattern.split(text) if pattern and any(m in text for m in marks) else [text]
            numbers = [self.special[m] for m in pieces[1::2]]
            parts += pieces[::2]
            owner += [i] * (len(numbers) + 1)
            after += [*numbers, -1]
        return parts, np.array(owner, dtype=np.int64), np.array(after, dtype=np.int64)

    @staticmethod
    def _chunks(parts: list[str]):
        first, size = 0, 0
        for i, part in enumerate(parts):
            if i > first and size + len(part) > CHUNK:
                yield first, i
                first, size = i, 0
            size += len(part)
        if len(parts) > first:
            yield first, len(parts)

    def count(self, texts: list[str]) -> np.ndarray:
        """The number of ids of each text."""
        parts, owner, after = self._parts(texts)
        out = np.bincount(owner[after >= 0], minlength=len(texts)).astype(np.int64)
        for a, b in self._chunks(parts):
            if any(parts[a:b]):
                of, entry = self._chunk(parts[a:b])
                out += np.bincount(owner[a + of], weights=self._lengths[entry], minlength=len(texts)).astype(np.int64)
        return out

    def ids(self, texts: list[str]):
        """Yields the ids of each text, in order."""
        parts, owner, after = self._parts(texts)
        waiting: list[np.ndarray] = []
        for a, b in self._chunks(parts):
            if any(parts[a:b]):
                of, entry = self._chunk(parts[a:b])
                sizes = self._lengths[entry]
                ends = np.cumsum(sizes)
                at = np.repeat(self._firsts[entry] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
                flat = self._pool[at]
                bounds = np.r_[0, np.cumsum(np.bincount(of, weights=sizes, minlength=b - a).astype(np.int64))]
            else:
                flat, bounds = np.zeros(0, dtype=np.uint32), np.zeros(b - a + 1, dtype=np.int64)
            for k in range(a, b):
                waiting.append(flat[bounds[k - a] : bounds[k - a + 1]])
                if after[k] >= 0:
                    waiting.append(np.array([after[k]], dtype=np.uint32))
                if k + 1 == len(parts) or owner[k + 1] != owner[k]:
                    yield waiting[0] if len(waiting) == 1 else np.concatenate(waiting)
                    waiting = []


@functools.lru_cache(maxsize=2)
def merger(path: str) -> PairMerger:
    """A worker's merger for a vocabulary file, which every executor has."""
    return PairMerger(path)
