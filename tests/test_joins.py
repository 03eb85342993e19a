import random
from bisect import bisect_left

import pytest
from pyspark.sql import functions as F

from ledgerwatch.operators.joins import asof_join, dedup_latest, latest_per_user
from ledgerwatch.operators.segments import _with_segment, cut_points
from ledgerwatch.schema import DAY_US, HOUR_US
from tests.conftest import BASE_US


def times(spark, rows, names):
    df = spark.createDataFrame(rows, f"{names[0]} string, {names[1]} string, us long")
    return df.withColumn("ts", F.timestamp_micros(F.col("us") * 1_000_000 + BASE_US)).drop("us")


@pytest.mark.parametrize("segment_rows", [10**9, 10])
def test_asof_equals_brute_force(spark, segment_rows):
    rng = random.Random(5)
    key = lambda i: "hot" if i % 3 == 0 else f"k{rng.randrange(8)}"
    left = [(f"l{i}", key(i), rng.randrange(0, 300_000, 500)) for i in range(200)]
    right = [(f"r{i:03d}", key(i), rng.randrange(0, 300_000, 500)) for i in range(150)]
    asked, known = times(spark, left, ["txn_id", "user_id"]), times(spark, right, ["snap", "user_id"])
    got = asof_join(asked, known.withColumnRenamed("ts", "at"), "user_id", "ts", "at", ["snap"], 48 * HOUR_US, tie="snap", segment_rows=segment_rows)

    def expected(k, s):
        earlier = [(t, r) for r, rk, t in right if rk == k and t <= s]
        if not earlier or s - max(earlier)[0] > 48 * 3600:
            return None
        return max(earlier)[1]

    assert {r.txn_id: r.snap for r in got.collect()} == {l: expected(k, s) for l, k, s in left}


def test_outdated_snapshot_is_no_match(spark):
    known = times(spark, [("r", "u", 0)], ["snap", "user_id"]).withColumnRenamed("ts", "at")
    asked = times(spark, [("ok", "u", 2 * 86400), ("late", "u", 2 * 86400 + 1)], ["txn_id", "user_id"])
    got = asof_join(asked, known, "user_id", "ts", "at", ["snap"], 2 * DAY_US, tie="snap")
    assert {r.txn_id: r.matched for r in got.collect()} == {"ok": True, "late": False}


def test_dedup_keeps_newest_of_many_copies(spark):
    rows = spark.range(2000).select(F.lit("same").alias("k"), F.col("id").alias("v")).unionAll(spark.range(3).selectExpr("cast(id as string)", "id"))
    got = {r.k: r.v for r in dedup_latest(rows, ["k"], [F.desc("v")]).collect()}
    assert got == {"same": 1999, "0": 0, "1": 1, "2": 2}


def test_latest_expires(spark):
    rows = times(spark, [("a", "u", 0), ("b", "v", 100_000)], ["txn_id", "user_id"])
    got = latest_per_user(rows, F.timestamp_micros(F.lit(BASE_US + 200_000 * 1_000_000)), 48, ts="ts").collect()
    assert [r.user_id for r in got] == ["v"]


def test_large_keys_are_cut_by_their_own_rows(spark):
    """A key whose rows crowd into a few seconds is cut as evenly as one spread over a year; small keys are not."""
    burst = [("burst", 10**15 + i) for i in range(3000)]
    spread = [("spread", i * 10**10) for i in range(3000)]
    rows = spark.createDataFrame(burst + spread + [("small", i) for i in range(50)], "k string, at long")
    assert cut_points(rows, ["k"], "at", 10**6) is None
    cuts = {r.k: r["_cuts"] for r in cut_points(rows, ["k"], "at", 100).collect()}
    assert set(cuts) == {"burst", "spread"}
    for key, start, step in (("burst", 10**15, 1), ("spread", 0, 10**10)):
        ends = [(c - start) // step for c in cuts[key]] + [2999]
        sizes = [b - a for a, b in zip([-1, *ends], ends)]
        assert len(ends) == 256 and max(sizes) < 30
    empty = spark.createDataFrame([], "k string, at long")
    assert cut_points(empty, ["k"], "at", 100) is None


@pytest.mark.parametrize("n", [1, 63, 64, 65, 128, 1000, 4095])
def test_a_row_meets_few_cuts(spark, n):
    """Segments are those of a plain search, and no row is joined to all cuts of its key or compared with them one by one."""
    ends = [10 * i for i in range(n)]
    cuts = spark.createDataFrame([("a", ends), ("b", [5])], "k string, _cuts array<bigint>")
    places = [None, -1, 0, 1, *random.Random(n).choices(range(10 * n), k=200), 10 * n - 10, 10 * n - 9, 10 * n]
    rows = spark.createDataFrame([(k, p) for k in ("a", "b", "c", None) for p in places], "k string, at bigint")
    found = _with_segment(rows, ["k"], "at", cuts)
    of = {"a": ends, "b": [5]}
    assert found.columns == ["k", "at", "_seg"]
    for r in found.collect():
        assert r["_seg"] == (0 if r["at"] is None else bisect_left(of.get(r.k, []), r["at"])), r
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "filter(" not in text and "_near" in text
