"""Metrics and drift statistics against NumPy and against the documented cases."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerwatch.operators import drift, metrics
from ledgerwatch.operators.ordering import code_of, cumulative_by_value, percentiles, selected
from ledgerwatch.session import small_table  # noqa: F401


def frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns))


def psi_of(spark, base, live):
    long = lambda x: frame(spark, feature=["f"] * len(x), value=np.asarray(x, float))
    edges = drift.quantile_edges(long(base))
    return drift.psi(drift.bucket_probs(long(base), edges), drift.bucket_probs(long(live), edges)).first().psi


def test_same_population_is_stable(spark):
    rng = np.random.default_rng(1)
    assert 0 <= psi_of(spark, rng.normal(0, 1, 5000), rng.normal(0, 1, 2000)) < 0.05


def test_shifted_population_drifts(spark):
    rng = np.random.default_rng(2)
    assert psi_of(spark, rng.normal(0, 1, 5000), rng.normal(2.5, 1, 2000)) > 0.25


def test_psi_equals_numpy(spark):
    rng = np.random.default_rng(9)
    base, live = rng.integers(0, 30, 3000) / 3, rng.normal(4, 3, 1000)
    edges = np.unique(np.quantile(base, np.linspace(0, 1, 11)))
    edges[0], edges[-1] = -np.inf, np.inf
    b, l = (np.clip(np.histogram(x, edges)[0] / len(x), 1e-6, None) for x in (base, live))
    assert psi_of(spark, base, live) == pytest.approx(float(np.sum((l - b) * np.log(l / b))), abs=2e-5)


@pytest.mark.parametrize("values", [[7.0] * 500, list(np.random.default_rng(3).normal(0, 1, 500))])
def test_probabilities_sum_to_one(spark, values):
    long = frame(spark, feature=["f"] * len(values), value=values)
    edges = drift.quantile_edges(long)
    live = frame(spark, feature=["f"] * 4, value=[1000.0, -1000.0, 0.0, 0.1])
    for rows in (long, live):
        probs = [r.prob for r in drift.bucket_probs(rows, edges).collect()]
        assert sum(probs) == pytest.approx(1, abs=1e-3) and np.isfinite(probs).all()


def test_rare_flag_is_blind_by_quantiles_and_seen_by_category(spark):
    base, live = [0.0] * 950 + [1.0] * 50, [0.0] * 400 + [1.0] * 600
    assert psi_of(spark, base, live) == 0
    long = lambda x: frame(spark, feature=["f"] * len(x), value=x)
    edges = drift.category_edges(long(base))
    assert drift.psi(drift.bucket_probs(long(base), edges), drift.bucket_probs(long(live), edges)).first().psi > 0.25


def test_empty_live_is_all_floor(spark):
    long = frame(spark, feature=["f"] * 100, value=np.arange(100.0))
    probs = drift.bucket_probs(long.limit(0), drift.quantile_edges(long)).collect()
    assert {r.prob for r in probs} == {1e-6} and len(probs) == 10


def test_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(4)
    values = np.where(rng.random(4000) < 1 / 3, 5.0, rng.normal(0, 10, 4000))
    group = np.where(rng.random(4000) < 0.5, "a", "b")
    got = percentiles(frame(spark, g=group, v=values), "v", {"p0": 0, "p50": 0.5, "p99": 0.99, "p100": 1}, ["g"]).collect()
    for r in got:
        assert [r.p0, r.p50, r.p99, r.p100] == pytest.approx(np.quantile(values[group == r.g], [0, 0.5, 0.99, 1]))
    whole = percentiles(frame(spark, v=values), "v", {"p95": 0.95}).first().p95
    assert whole == pytest.approx(np.quantile(values, 0.95))


def scores(seed=6, n=1500):
    rng = np.random.default_rng(seed)
    y = rng.random(n) < 0.2
    s = np.round(np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1), 2)  # many ties
    return s, y


def test_auc_and_average_precision(spark):
    s, y = scores()
    df = frame(spark, s=s, y=y)
    pos, neg = s[y], s[~y]
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    assert metrics.auc(df, "s", "y").first().auc == pytest.approx(wins / len(pos) / len(neg))
    ap = 0.0
    for t in np.unique(s)[::-1]:
        ap += (y & (s == t)).sum() / y.sum() * (y & (s >= t)).sum() / (s >= t).sum()
    assert metrics.average_precision(df, "s", "y").first().average_precision == pytest.approx(ap)


def test_auc_of_one_class_is_null(spark):
    assert metrics.auc(frame(spark, s=[0.1, 0.2], y=[True, True]), "s", "y").first().auc is None


def test_threshold_sweep(spark):
    s, y = scores(8)
    best, chosen = 0.0, 0.5
    for k in range(1, 100):
        flagged = s >= k / 100 - 1e-9
        rate = flagged.mean()
        if rate > 3 * y.mean() or rate < 0.5 * y.mean() or not flagged.any():
            continue
        p, r = (flagged & y).sum() / flagged.sum(), (flagged & y).sum() / y.sum()
        f = 1.25 * p * r / (0.25 * p + r) if p + r else 0
        if f > best + 1e-15:
            best, chosen = f, k / 100
    got = metrics.best_threshold(metrics.threshold_table(frame(spark, s=s, y=y), "s", "y")).first()
    assert (got.best_threshold, got.best_f05) == (pytest.approx(chosen), pytest.approx(best))


def test_no_admissible_threshold(spark):
    df = frame(spark, s=[0.005] * 50 + [0.005] * 50, y=[True] * 50 + [False] * 50)
    got = metrics.best_threshold(metrics.threshold_table(df, "s", "y")).first()
    assert tuple(got) == (0.5, 0.0, 0.0)


def test_ks(spark):
    rng = np.random.default_rng(11)
    a, b = rng.normal(0, 1, 700), rng.normal(0.3, 1, 500)
    points = np.concatenate([a, b])
    d = max(abs((a <= x).mean() - (b <= x).mean()) for x in points)
    got = metrics.ks_two_sample(frame(spark, v=points, live=[False] * 700 + [True] * 500), "v", "live").first()
    lam = d * np.sqrt(700 * 500 / 1200)
    p = 2 * sum((-1) ** (k - 1) * np.exp(-2 * k * k * lam * lam) for k in range(1, 101))
    assert got.ks_statistic == pytest.approx(d) and got.ks_pvalue == pytest.approx(p)


def test_ks_needs_rows(spark):
    df = frame(spark, v=[0.1] * 19 + [0.2] * 50, live=[False] * 19 + [True] * 50)
    assert tuple(metrics.ks_two_sample(df, "v", "live").first()) == (None, None)


def test_ks_of_equal_samples(spark):
    df = frame(spark, v=[0.1, 0.2] * 50, live=[False] * 50 + [True] * 50)
    assert tuple(metrics.ks_two_sample(df, "v", "live").first()) == (0.0, 1.0)


@pytest.mark.parametrize("minutes, triggered", [(59, False), (60, True)])
def test_cooldown(spark, minutes, triggered):
    events = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS checked_at, true AS retrain_triggered")
    check = spark.sql("SELECT true AS drift_detected")
    as_of = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=F.lit(minutes))
    row = drift.retrain_decision(check, events, as_of).first()
    assert row.retrain_triggered is triggered and (row.retrain_skipped_reason is None) is triggered


def test_failed_retrain_starts_no_cooldown(spark):
    events = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS checked_at, false AS retrain_triggered")
    check = spark.sql("SELECT true AS drift_detected")
    assert drift.retrain_decision(check, events, F.lit("2024-01-01 00:01:00").cast("timestamp")).first().retrain_triggered


ODD = [0.0, -0.0, 5e-324, -5e-324, 2.2e-308, 1e-300, 1.0, np.nextafter(1.0, 2), np.nextafter(1.0, 0), -1.0, 1e308, 1.7976931348623157e308, -1e308, float("inf"), float("-inf")]


def test_codes_grow_with_values(spark):
    rng = np.random.default_rng(8)
    close = np.concatenate([x * (1 + np.arange(200) * 2.0**-52) for x in rng.lognormal(0, 50, 20)])
    values = np.sort(np.concatenate([ODD, rng.normal(0, 1, 2000), rng.lognormal(0, 200, 2000), -rng.lognormal(0, 200, 2000), close]))
    found = frame(spark, v=values).select("v", code_of(F.col("v")).alias("code")).toPandas().sort_values("v")
    codes = found["code"].to_numpy()
    assert (np.diff(codes) >= 0).all() and len(np.unique(codes)) > 4000
    assert spark.createDataFrame([(float("nan"),)], "v double").select(code_of(F.col("v"))).first()[0] > codes.max()


def test_percentiles_of_odd_values(spark):
    """Values of one code, of all sizes, ties and nulls; a key without values has no row."""
    rng = np.random.default_rng(12)
    groups = {
        "close": 1.0 + np.arange(3000) * 2.0**-52,
        "wide": np.concatenate([rng.lognormal(0, 200, 500), -rng.lognormal(0, 200, 500), [0.0] * 100]),
        "odd": np.array([x for x in ODD if abs(x) < 1e300]),
        "ties": rng.integers(-2, 3, 999).astype(float),
        "one": np.array([4.5]),
    }
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("none", None), ("one", None), (None, 2.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in percentiles(df, "v", {"p0": 0.0, "p37": 0.37, "p95": 0.95, "p100": 1.0}, ["g"]).collect()}
    assert set(got) == set(groups) | {None}
    groups[None] = np.array([2.0, 4.0])
    for g, v in groups.items():
        expected = np.quantile(v, [0, 0.37, 0.95, 1])
        assert [got[g].p0, got[g].p37, got[g].p95, got[g].p100] == pytest.approx(expected, rel=1e-12, abs=0), g
    assert percentiles(df.where("v is null"), "v", {"p50": 0.5}).first().p50 is None


def test_several_measures_and_totals(spark):
    rows = [("a", 1.0, None), ("a", 3.0, None), ("b", 2.0, 7.0), ("b", None, 9.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    measures = {"x": (F.col("x"), {"x50": 0.5}), "y": (F.col("y"), {"y50": 0.5, "y100": 1.0})}
    got = selected(df, measures, ["g"], {"n": F.lit(1), "s": F.col("x")}).drop("_most")
    assert {tuple(r) for r in got.collect()} == {("a", 2.0, None, None, 2, 4.0), ("b", 2.0, 8.0, 9.0, 2, 2.0)}
    nothing = selected(df.where("g = 'a'"), {"y": measures["y"]}, totals={"n": F.lit(1)}).first()
    assert (nothing.y50, nothing.n) == (None, 2)
    assert selected(df.limit(0), measures, totals={"n": F.lit(1)}).count() == 1


def test_cumulative_sums_by_value(spark):
    rng = np.random.default_rng(21)
    values = np.concatenate([1.0 + np.arange(300) * 2.0**-52, rng.normal(0, 1, 500).round(1), rng.lognormal(0, 100, 200)])
    keys = rng.choice(["p", "q"], len(values))
    df = frame(spark, g=keys, v=values)
    got = cumulative_by_value(df, "v", {"n": F.lit(1)}, ["g"]).collect()
    assert len(got) == len({(k, v) for k, v in zip(keys, values)})
    for r in got:
        mine = values[keys == r.g]
        assert (r.n, r.n_before, r.n_total) == ((mine == r.v).sum(), (mine < r.v).sum(), len(mine))


def test_stored_scores_replace_the_old_predictions(spark):
    rng = np.random.default_rng(14)
    old, new = rng.beta(2, 5, 900).round(3), rng.beta(2, 4, 400).round(3)
    both = frame(spark, p=np.concatenate([old, new]), live=np.arange(1300) >= 900)
    direct = metrics.ks_two_sample(both, "p", "live").first()
    stored = drift.baseline_scores(frame(spark, fraud_probability=old), "7")
    assert {r.score: r.n for r in stored.collect()} == {v: (old == v).sum() for v in old} and stored.first().model_version == "7"
    rows = stored.select("score", F.col("n").alias("a"), F.lit(0).alias("b"))
    rows = rows.unionByName(frame(spark, score=new).select("score", F.lit(0).alias("a"), F.lit(1).alias("b")))
    assert metrics.ks_of_counts(rows, "score", F.col("a"), F.col("b")).first() == direct
    few = metrics.ks_of_counts(rows.where("b = 0 or score > 0.9"), "score", F.col("a"), F.col("b")).first()
    assert few.ks_statistic is None and few.ks_pvalue is None
