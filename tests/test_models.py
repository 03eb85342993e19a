import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwatch.functions import signals
from ledgerwatch.operators import checks, labels, routing, scoring
from ledgerwatch.schema import FEATURE_COLUMNS


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (1500, 2))
    y = rng.random(1500) < 1 / (1 + np.exp(-(2 * x[:, 0] - 1.5)))
    rows = [(f"t{i}", float(a), float(b), bool(c)) for i, ((a, b), c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "txn_id string, a double, b double, is_fraud boolean")
    return scoring.stratified_split(df).cache()


def test_split_has_exact_shares_per_class(frame):
    counts = {(r.is_fraud, r.part): r.n for r in frame.groupBy("is_fraud", "part").agg(F.count("*").alias("n")).collect()}
    for label in (True, False):
        n = sum(v for (c, _), v in counts.items() if c == label)
        assert abs(counts[label, "test"] - 0.1 * n) <= 1
        assert abs(counts[label, "val"] - 0.2 * n) <= 1


def test_models_learn(frame):
    from ledgerwatch.operators.metrics import auc

    for fit in (lambda: scoring.train_gbt(frame, features=["a", "b"], rounds=10, depth=3), lambda: scoring.train_linear(frame, features=["a", "b"])):
        scored = scoring.score(fit(), frame.where("part = 'test'"), "v")
        assert auc(scored, "fraud_probability", "is_fraud").first().auc > 0.75


def test_training_is_refused(frame):
    with pytest.raises(ValueError, match="only .* labeled rows"):
        scoring.train_gbt(frame, features=["a", "b"], min_rows=10**6)
    with pytest.raises(ValueError, match="one class"):
        scoring.train_linear(frame.where("not is_fraud"), features=["a", "b"], min_rows=10)


def test_attributions_add_up(frame):
    weights = {"a": 2.0, "b": -0.5}
    rows = scoring.attributions(frame, weights)
    score = 2.0 * F.col("a") - 0.5 * F.col("b")
    mean = frame.agg(F.avg(score)).first()[0]
    worst = rows.agg(F.max(F.abs(F.col("phi_a") + F.col("phi_b") - (score - mean)))).first()[0]
    assert worst < 1e-9


def test_top_attributions_order(spark):
    row = spark.sql("SELECT 1D AS a, 2D AS b, 3D AS c, 0.5D AS phi_a, -2D AS phi_b, 0.5D AS phi_c")
    top = scoring.top_attributions(row, ["a", "b", "c"], 2).first().top_features
    assert [(t.feature, t.attribution, t.feature_value) for t in top] == [("b", -2.0, 2.0), ("a", 0.5, 1.0)]


@pytest.fixture(scope="module")
def ids(spark):
    return spark.range(20_000).select(F.concat(F.lit("t"), "id").alias("txn_id"))


def test_split_route(ids):
    routed = routing.split_route(ids, ["a", "b"], 30)
    assert abs(routed.where("model_version = 'a'").count() / 20_000 - 0.3) < 0.02
    assert routed.exceptAll(routing.split_route(ids.repartition(5), ["a", "b"], 30)).count() == 0
    assert routing.split_route(ids, ["only"], 30).where("model_version = 'only'").count() == 20_000


def test_thompson_prefers_the_better_model_and_repeats(ids):
    routed = routing.thompson_route(ids, ["good", "bad"], [80.0, 20.0], [20.0, 80.0])
    assert routed.where("model_version = 'good'").count() > 19_900
    even = routing.thompson_route(ids, ["x", "y"], [5.0, 5.0], [5.0, 5.0])
    assert even.exceptAll(routing.thompson_route(ids.repartition(3), ["x", "y"], [5.0, 5.0], [5.0, 5.0])).count() == 0
    assert 0.45 < even.where("model_version = 'x'").count() / 20_000 < 0.55


@pytest.mark.parametrize("a, b, c, d", [(1, 1, 1, 1), (3, 7, 2, 9), (40, 12, 35, 20), (5, 200, 9, 180), (2, 50, 60, 3)])
def test_win_probability(a, b, c, d):
    rng = np.random.default_rng(3)
    drawn = (rng.beta(a, b, 400_000) > rng.beta(c, d, 400_000)).mean()
    assert routing.win_probability(a, b, c, d) == pytest.approx(drawn, abs=4e-3)
    assert routing.win_probability(a, b, c, d) + routing.win_probability(c, d, a, b) == pytest.approx(1)


@pytest.mark.parametrize("seen, thompson", [(29, False), (30, True)])
def test_burn_in(spark, ids, seen, thompson):
    posteriors = spark.createDataFrame([("a", 0, seen + 1.0, 1.0), ("b", 1, 1.0, 1.0)], "model_version string, slot int, alpha double, beta double")
    share = routing.route(ids, posteriors, 10).where("model_version = 'a'").count() / 20_000
    assert (share > 0.9) is thompson


def test_posteriors_without_labels(spark):
    serving = spark.createDataFrame([("a", 0)], "model_version string, slot int")
    p = spark.createDataFrame([("t", True, "shadow_a")], "txn_id string, is_flagged boolean, model_version string")
    lab = spark.createDataFrame([("t", True)], "txn_id string, is_fraud boolean")
    row = routing.bandit_posteriors(serving, p, lab).first()
    assert (row.alpha, row.beta) == (1.0, 1.0)


def risk(spark, n, amount, home):
    user = "u1"
    df = spark.range(n).select(F.concat(F.lit("t"), "id").alias("txn_id"), F.lit(user).alias("user_id"), F.lit(float(amount)).alias("amount"))
    country = signals.home_country(F.lit(user)) if home else F.lit("ZZ")
    df = df.withColumns({"ip_country": country, "channel": F.lit("upi"), "merchant_category": F.lit("groceries"), "delay_hours": F.lit(1.0)})
    rows = labels.rule_labels(df, F.lit("2024-01-01").cast("timestamp"))
    return rows.agg(F.avg(F.col("is_fraud").cast("double"))).first()[0]


def test_label_rates(spark):
    low, high = risk(spark, 20_000, 10, True), risk(spark, 5_000, 5000, False)
    assert low < 0.10 and high > low


def test_home_country_is_fixed_and_equals_sql(spark):
    import hashlib

    from ledgerwatch.schema import HOME_COUNTRIES

    signals.register_sql_functions(spark)
    df = spark.range(200).select(F.concat(F.lit("user_"), "id").alias("u"))
    for r in df.select("u", signals.home_country("u").alias("a"), F.expr("home_country(u)").alias("b")).collect():
        expected = HOME_COUNTRIES[int(hashlib.sha256(r.u.encode()).hexdigest(), 16) % 8]
        assert r.a == r.b == expected
    one = spark.sql("SELECT rule_score(1500D, 'ZZ', 'u', 'card_not_present', 'crypto') AS s, rule_score(10D, '', 'u', 'upi', 'x') AS t").first()
    assert (one.s, one.t) == (0.98, 0.01)


def test_cold_vector(spark):
    row = spark.range(1).select(*[F.lit(None).cast("string").alias(c) for c in FEATURE_COLUMNS], F.lit(None).cast("string").alias("snapshot_key"))
    got = signals.vector_columns(row).first()
    assert got.is_cold_start and all(got[c] == 0.0 for c in FEATURE_COLUMNS)


def test_contract_fails_nulls(spark):
    row = spark.range(1).select(*[F.lit(1.0).alias(c) for c in FEATURE_COLUMNS[:-1]], F.lit(None).cast("double").alias(FEATURE_COLUMNS[-1]))
    assert checks.check_features(row).first().failed == [FEATURE_COLUMNS[-1]]


def test_rounding_is_half_up(spark):
    cases = [(30086.2585, 3, 30086.259), (-7.9140625, 6, -7.914063), (2.5e-7, 6, 0.0), (0.1234565, 6, 0.123457), (-1e-9, 6, 0.0), (12.0, 3, 12.0)]
    cases += [(k / 1000 + 0.0005, 3, (k + 1) / 1000) for k in range(1, 90_000, 997)]
    rows = spark.createDataFrame([(v, e) for v, p, e in cases if p == 3], "v double, e double")
    assert rows.where(signals.rounded(F.col("v"), 3) != F.col("e")).count() == 0
    six = spark.createDataFrame([(v, e) for v, p, e in cases if p == 6], "v double, e double")
    assert six.where(signals.rounded(F.col("v"), 6) != F.col("e")).count() == 0


def test_modes_of_serving(spark):
    from ledgerwatch.operators.routing import assign

    txns = spark.range(20).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("txn_id"))
    both = spark.createDataFrame([("9", 0, 1.0, 1.0), ("8", 1, 1.0, 1.0)], "model_version string, slot int, alpha double, beta double")
    shadow = {(r.txn_id, r.model_version, r.is_shadow) for r in assign(txns, both, "shadow").collect()}
    assert shadow == {(f"t{k}", *x) for k in range(20) for x in (("8", False), ("shadow_9", True))}
    for mode, posteriors in (("ab_test", both), ("shadow", both.where("slot = 0"))):
        rows = assign(txns, posteriors, mode).collect()
        assert len(rows) == 20 and not any(r.is_shadow for r in rows)
    with pytest.raises(ValueError):
        assign(txns, both, "canary")
