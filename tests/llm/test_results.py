"""Every corpus operator against a plain restatement, over odd rows, an empty table and the given documents."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerwatch.llm import exact_dedup, license_scan, line_dedup, mixing, packing, quality_classifier, quality_rules, queries, secret_scan, simhash, token_counts
from ledgerwatch.llm.common import documents
from tests.compare import connect, differences

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def _rows(df, *names):
    return Counter(tuple(r[n] for n in names) for r in df.select(*names).collect())


@pytest.fixture(scope="module", params=["odd", "given", "empty"])
def case(request, spark, folder, docs_of, odd_rows):
    if request.param == "given":
        df = documents(spark, folder)
    else:
        df = docs_of(odd_rows if request.param == "odd" else [])
    return df, [tuple(r) for r in df.select("doc_id", "text", "lang", "source").collect()]


def test_line_dedup(case):
    df, rows = case
    holders = defaultdict(set)

    def key(line):
        return _lower(line.strip(" \t\n\x0b\x0c\r"))

    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(i)
    lost = {k: max(x for x in v if x is not None) for k, v in holders.items() if len(v) >= 5}
    expected = Counter()
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if key(x) not in lost or lost[key(x)] == i]
        expected[(i, len(lines), len(lines) - len(left), "\n".join(left))] += 1
    assert _rows(line_dedup.line_dedup(df), "doc_id", "n_lines", "n_dropped", "kept_text") == expected


def test_packing(case):
    df, rows = case
    tokenizer = Tokenizer.from_file(VOCABULARY)
    expected = Counter()
    for i, t, *_ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        start = 0
        for k, size in enumerate([n for n in [len(ids) % 1024] if n] + [1024] * (len(ids) // 1024)):
            part = b"".join(x.to_bytes(4, "little") for x in ids[start : start + size])
            expected[(i, k, start, size, zlib.crc32(part))] += 1
            start += size
    found = packing.pack(df, VOCABULARY).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == expected
    filled = defaultdict(list)
    for r in found:
        filled[r.sequence_id].append((r.offset, r.length))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    least = -(-sum(r.length for r in found) // 1024)
    assert least <= len(filled) <= least * 1.01 + 2


def test_token_counts(case):
    df, rows = case
    tokenizer = Tokenizer.from_file(VOCABULARY)
    expected = Counter()
    for i, t, *_ in rows:
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        expected[(i, len((t or "").encode()), n, n > 1024)] += 1
    assert _rows(token_counts.token_counts(df, VOCABULARY), "doc_id", "n_bytes", "n_tokens", "over_limit") == expected


def test_classifier_keeps_every_row(case, spark):
    df, rows = case
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (6, 1, 1), (None, 1, 0), (7, None, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    found = quality_classifier.classify(df, labels).collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in rows)
    assert all(0 <= r.p_quality <= 1 and 0 <= r.p_toxic <= 1 and r.kept is not None for r in found)
    none = quality_classifier.classify(df, labels.limit(0)).collect()
    assert {(r.p_quality, r.p_toxic) for r in none} <= {(0.5, 0.5)}


def test_mixing(case):
    df, rows = case
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        free = [s for s in sizes if s not in capped]
        level = (total - sum(3 * sizes[s] for s in capped)) / (sum(weight[s] for s in free) or 1)
        over = {s for s in free if 3 * sizes[s] < level * weight[s]}
        if not over:
            break
        capped |= over
    target = {s: 3 * sizes[s] if s in capped else level * weight[s] for s in sizes}
    found = mixing.mix(df).collect()
    assert Counter((r.doc_id, r.size) for r in found) == Counter((i, len(WORD.findall(t or ""))) for i, t, *_ in rows)
    taken = Counter()
    for r in found:
        assert 0 <= r.taken <= 3 * r.size
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    again = mixing.mix(df.repartition(7))
    assert _rows(again, "doc_id", "taken") == Counter((r.doc_id, r.taken) for r in found)
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    words = Counter()
    for r in mixed.select("text", "source").collect():
        words[r.source] += len(WORD.findall(r.text or ""))
    assert words == +taken


def test_license_scan(case, spark):
    df, rows = case

    def shingles(text):
        words = re.findall("[a-z0-9]+", _lower(text))
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()

    templates = {k: shingles(v) for k, v in license_scan.TEMPLATES.items()}
    held = [(i, shingles(t or "")) for i, t, *_ in rows]
    expected = Counter((i, k) for i, s in held for k, v in templates.items() if len(v & s) >= 0.8 * len(v))
    assert _rows(license_scan.license_scan(df, license_scan.license_templates(spark)), "doc_id", "license") == expected
    none = license_scan.license_templates(spark).limit(0)
    assert license_scan.license_scan(df, none).count() == 0


def _fingerprint(text):
    words = WORD.findall(_lower(text))
    if not words:
        return 0
    parts = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(marks):
    """Smallest id reachable over fingerprints at distance up to four, by brute force."""
    distinct = sorted(set(marks.values()))
    root = {f: f for f in distinct}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for k, a in enumerate(distinct):
        for b in distinct[:k]:
            if (a ^ b).bit_count() <= 4:
                root[top(a)] = top(b)
    return {f: top(f) for f in distinct}


def test_simhash(case):
    df, rows = case
    marks = {k: _fingerprint(r[1] or "") for k, r in enumerate(rows)}
    root = _components(marks)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[root[marks[k]]] = min(r[0], least.get(root[marks[k]], r[0]))
    expected = Counter((r[0], f"{marks[k]:016x}", least.get(root[marks[k]])) for k, r in enumerate(rows))
    assert _rows(simhash.near_dedup(df), "doc_id", "fingerprint", "component_id") == expected
    left = simhash.drop_near_copies(df)
    assert left.columns == df.columns and left.count() == len(set(root.values()))


def test_quality_rules(case):
    df, rows = case
    expected = Counter()
    for i, t, *_ in rows:
        t = t or ""
        words = WORD.findall(t)
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        often = Counter(windows)
        repeated = {k + d for k, w in enumerate(windows) if often[w] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        expected[(i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated), len(words) < 50 or 100 * len(repeated) > 50 * len(words))] += 1
    found = quality_rules.quality_rules(df)
    assert _rows(found, "doc_id", *["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"], "base_failed") == expected
    left = quality_rules.drop_bad(df)
    assert left.columns == df.columns and left.count() == found.where("kept").count()


def test_exact_dedup(case):
    df, rows = case
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    expected, stay = Counter(), 0
    for text, ids in groups.items():
        best = max((x for x in ids if x is not None), default=None)
        stay += 1
        for k, i in enumerate(sorted(ids, key=str)):
            first = i == best and sorted(ids, key=str).index(i) == k
            expected[(i, best, len(ids), first, hashlib.sha256(text.encode()).hexdigest())] += 1
    found = exact_dedup.exact_dedup(df).withColumn("sha", F.lower(F.hex("digest")))
    assert _rows(found, "doc_id", "keep_id", "group_size", "kept", "sha") == expected
    left = exact_dedup.drop_copies(df)
    assert left.columns == df.columns and left.count() == stay


def test_secret_scan(case):
    df, rows = case
    assign = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    expected = Counter()
    for i, t, *_ in rows:
        t = t or ""
        spans = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
        spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        n = Counter(s[2] for s in spans)
        expected[(i, n["assign"], n["access"], n["hex"], ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans)))] += 1
    assert _rows(secret_scan.secret_scan(df), "doc_id", "n_assign", "n_access", "n_hex", "spans") == expected


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, folder, name):
    assert differences(queries.queries()[name](spark, folder), connect(folder), queries.oracle_sql()[name]) == []
