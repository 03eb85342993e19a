"""Every operator as a named query over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ledgerwatch.functions import signals
from ledgerwatch.operators import (
    behaviour as bh,
    checks,
    drift,
    graph,
    joins,
    labels as lb,
    metrics as mt,
    registry as rg,
    routing,
    scoring,
)
from ledgerwatch.plans import reports
from ledgerwatch.plans.snapshots import feature_snapshots
from ledgerwatch.schema import FEATURE_COLUMNS, HOUR_US, MODEL_NAME, ONLINE_TTL_HOURS
from ledgerwatch.session import persist_table, pin_session, small_table
from ledgerwatch.sources import envelope, sinks, tables

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}


def _at(text: str) -> Column:
    return F.lit(text).cast("timestamp")


NOW = "2024-01-31 00:00:00"
FLAGGED_BY = NOW
SPLIT_AT = "2024-01-16 00:00:00"

# Weights of the linear score that the attribution queries explain.
WEIGHTS = {c: round((-1) ** i * (i + 1) / 10, 1) for i, c in enumerate(FEATURE_COLUMNS)}


def plain(df: DataFrame) -> DataFrame:
    """Integers as bigint, times without zone, doubles to six places: comparable with any SQL engine."""
    out = []
    for field in df.schema:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("bigint")
        elif isinstance(field.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(field.dataType, T.DoubleType):
            c = signals.rounded(c, 6)
        out.append(c.alias(field.name))
    return df.select(*out)


def query(fn: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        pin_session(spark)
        return plain(fn(spark, folder))

    _QUERIES[fn.__name__] = run
    return fn


def all_queries() -> dict[str, Query]:
    from ledgerwatch.plans import streams  # noqa: F401  registers the streaming queries

    return dict(_QUERIES)


# -- stored tables -----------------------------------------------------------------------

_STORED: dict[tuple, DataFrame] = {}


def _stored(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table, written once per application to the shared folder and scanned from there."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _STORED:
        _STORED[key] = persist_table(build(), name)
    return _STORED[key]


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """The snapshot table: written a second after the transaction."""

    def build() -> DataFrame:
        rows = feature_snapshots(tables.transactions(spark, folder), tables.labels(spark, folder))
        return rows.withColumn("computed_at", F.col("txn_timestamp") + F.expr("INTERVAL 1 SECOND"))

    return _stored(spark, folder, "feature_snapshots", build)


def shifted_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshots of a population whose amounts triple halfway."""

    def build() -> DataFrame:
        txns = tables.transactions(spark, folder)
        amount = F.when(F.col("txn_timestamp") >= _at(SPLIT_AT), F.col("amount") * 3).otherwise(F.col("amount"))
        return feature_snapshots(txns.withColumn("amount", amount), tables.labels(spark, folder))

    return _stored(spark, folder, "shifted_snapshots", build)


def _halves(df: DataFrame, ts: str = "txn_timestamp") -> tuple[DataFrame, DataFrame]:
    return tables.read_window(df, ts, _at("2000-01-01 00:00:00"), _at(SPLIT_AT)), tables.read_window(df, ts, _at(SPLIT_AT))


def _scored_labels(spark: SparkSession, folder: str) -> DataFrame:
    scores = tables.predictions(spark, folder).select("txn_id", "fraud_probability", "is_flagged", "model_version")
    return scores.join(tables.labels(spark, folder).select("txn_id", "is_fraud"), "txn_id")


# -- features ----------------------------------------------------------------------------


@query
def feature_snapshots_query(spark, folder):
    return feature_snapshots(tables.transactions(spark, folder), tables.labels(spark, folder))


_QUERIES["feature_snapshots"] = _QUERIES.pop("feature_snapshots_query")


def _behaviour(spark, folder, family: str, inputs: list[str], *columns) -> DataFrame:
    """One family of features, from the input columns it needs."""
    rows = tables.transactions(spark, folder).select("txn_id", "user_id", "txn_timestamp", *inputs)
    absent = {c: F.lit(None).cast(t) for c, t in _INPUTS.items() if c not in inputs}
    return bh.behaviour(rows.withColumns(absent) if absent else rows, families=(family,)).select("txn_id", *columns)


_INPUTS = {"amount": "double", "merchant_id": "string", "ip_country": "string"}


@query
def txn_velocity(spark, folder):
    return _behaviour(spark, folder, "velocity", [], "txn_velocity_1h", "txn_velocity_24h")


@query
def amount_stats(spark, folder):
    return _behaviour(spark, folder, "amount", ["amount"], "amount_mean_24h", "amount_std_24h")


@query
def amount_zscore(spark, folder):
    return _behaviour(spark, folder, "amount", ["amount"], "amount_zscore")


@query
def distinct_merchants(spark, folder):
    return _behaviour(spark, folder, "merchants", ["merchant_id"], "distinct_merchants_1h", "distinct_merchants_24h")


@query
def seconds_since_last(spark, folder):
    return _behaviour(spark, folder, "last", [], "seconds_since_last_txn")


@query
def one_user_features(spark, folder):
    """Users by the five characters their ids share, so that all rows are one user's, who is cut into segments."""
    rows = tables.transactions(spark, folder).withColumn("user_id", F.substring("user_id", 1, 5))
    cut = bh.behaviour(rows, segment_rows=100)
    return cut.select(
        "txn_id", "txn_velocity_1h", "txn_velocity_24h", "amount_mean_24h", "amount_std_24h", "distinct_merchants_1h",
        "distinct_merchants_24h", "impossible_travel_flag", "seconds_since_last_txn",
    )


@query
def impossible_travel(spark, folder):
    return _behaviour(spark, folder, "last", ["ip_country"], "impossible_travel_flag")


def _purchases(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as a denser history without time of day: a customer's purchases from suppliers."""
    lines = tables.read_table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"
    )
    orders = tables.read_table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("txn_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("l_extendedprice").alias("amount"),
        F.col("l_suppkey").alias("merchant_id"),
        F.col("l_shipdate").cast("timestamp").alias("txn_timestamp"),
        F.col("o_orderpriority").alias("ip_country"),
    )


@query
def purchase_behaviour(spark, folder):
    """The same operator on other tables: many purchases of one instant, which stay out of each other's history."""
    rows = bh.behaviour(_purchases(spark, folder))
    return rows.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("purchases"),
        F.sum("txn_velocity_24h").alias("velocity"),
        F.sum("distinct_merchants_24h").alias("merchants"),
        F.sum("amount_mean_24h").alias("means"),
        F.sum("amount_std_24h").alias("spreads"),
    )


@query
def direct_signals(spark, folder):
    rows = signals.with_direct_signals(tables.transactions(spark, folder))
    return rows.select("txn_id", "is_foreign_ip", "log_amount", "is_card_not_present", "is_high_risk_category")


@query
def home_country(spark, folder):
    users = tables.transactions(spark, folder).select("user_id").distinct()
    return users.select("user_id", signals.home_country("user_id").alias("home_country"))


def _versions(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshots with one corrected copy an hour later for every transaction above 200."""
    base = tables.transactions(spark, folder).select("txn_id", "user_id", "amount", F.col("txn_timestamp").alias("computed_at"))
    later = base.where("amount > 200").withColumns(
        {"amount": F.col("amount") + 1, "computed_at": F.col("computed_at") + F.expr("INTERVAL 1 HOUR")}
    )
    return base.unionByName(later)


@query
def dedup_latest(spark, folder):
    return joins.dedup_latest(_versions(spark, folder), ["txn_id"], [F.desc("computed_at")])


@query
def latest_features(spark, folder):
    rows = bh.behaviour(tables.transactions(spark, folder)).withColumn(
        "computed_at", F.col("txn_timestamp") + F.expr("INTERVAL 1 SECOND")
    )
    latest = joins.latest_per_user(rows, _at(NOW), ONLINE_TTL_HOURS)
    return latest.select("user_id", "txn_id", "computed_at", "txn_velocity_24h", "amount_mean_24h", "distinct_merchants_24h")


def _asof(spark: SparkSession, folder: str, keep: list[str]) -> DataFrame:
    asked = tables.transactions(spark, folder).select("txn_id", "user_id", "txn_timestamp")
    known = snapshots(spark, folder).withColumn("snapshot_key", F.col("txn_id"))
    return joins.asof_join(
        asked, known, "user_id", "txn_timestamp", "computed_at", keep, max_age_us=ONLINE_TTL_HOURS * HOUR_US
    )


@query
def asof_features(spark, folder):
    rows = _asof(spark, folder, ["snapshot_key", "txn_velocity_24h", "amount_mean_24h"])
    return rows.select("txn_id", "snapshot_key", "txn_velocity_24h", "amount_mean_24h", "matched")


@query
def feature_vector(spark, folder):
    rows = signals.vector_columns(_asof(spark, folder, ["snapshot_key", *FEATURE_COLUMNS]))
    return rows.select("txn_id", *FEATURE_COLUMNS, "is_cold_start")


@query
def feature_contract(spark, folder):
    """Snapshots with a defect wherever a value of the source points to one."""
    rows = snapshots(spark, folder)
    number = F.regexp_extract("txn_id", "([0-9]+)", 1).cast("bigint")
    broken = rows.withColumns(
        {
            "txn_velocity_1h": F.when(number % 97 == 0, 0).otherwise(F.col("txn_velocity_1h")),
            "amount_mean_24h": F.when(number % 89 == 0, -1.0).otherwise(F.col("amount_mean_24h")),
            "impossible_travel_flag": F.when(number % 83 == 0, 2).otherwise(F.col("impossible_travel_flag")),
            "log_amount": F.when(number % 79 != 0, F.col("log_amount")),
            "seconds_since_last_txn": F.when(number % 73 == 0, -2.0).otherwise(F.col("seconds_since_last_txn")),
        }
    )
    checked = checks.check_features(broken)
    return checked.where(F.size("failed") > 0).select("txn_id", F.array_join("failed", ",").alias("failed"))


@query
def window_scan(spark, folder):
    rows = tables.read_window(
        tables.transactions(spark, folder), "txn_timestamp", _at("2024-01-10 00:00:00"), _at("2024-01-12 00:00:00")
    )
    return rows.select("txn_id", "user_id", "amount", "txn_timestamp")


# -- validation --------------------------------------------------------------------------


def _validated(spark: SparkSession, folder: str) -> DataFrame:
    return envelope.validate(envelope.decode_envelope(tables.raw_payloads(spark, folder)))


@query
def decode_envelope(spark, folder):
    rows = envelope.decode_envelope(tables.raw_payloads(spark, folder))
    return rows.select(
        "offset",
        F.coalesce("decode_error", F.lit("ok")).alias("status"),
        F.try_variant_get("data", "$.txn_id", "string").alias("txn_id"),
    )


@query
def txn_validation(spark, folder):
    return _validated(spark, folder).select(
        "offset", F.array_join("reasons", ",").alias("reasons"), "txn_id", "amount", "currency", "txn_timestamp", "channel"
    )


@query
def valid_invalid_counts(spark, folder):
    ok = (F.size("reasons") == 0).alias("valid")
    return _validated(spark, folder).groupBy(ok).agg(F.count(F.lit(1)).alias("rows"))


@query
def dlq_rows(spark, folder):
    return envelope.quarantine_rows(_validated(spark, folder))


@query
def dlq_by_reason(spark, folder):
    return envelope.reasons_summary(envelope.quarantine_rows(_validated(spark, folder)))


@query
def dlq_replay(spark, folder):
    """Repair the enum defect of quarantined messages and take in what is valid and new."""
    bad = envelope.quarantine_rows(_validated(spark, folder))
    stored = envelope.valid_rows(_validated(spark, folder))
    fixed = envelope.replay(bad, stored, F.replace(F.col("raw"), F.lit("telepathy"), F.lit("upi")))
    return fixed.select("txn_id", "amount", "channel")


@query
def integrity_report(spark, folder):
    """Rule violations in tables with known faults: odd probabilities, lost transactions, doubled labels."""
    p = tables.predictions(spark, folder)
    p = p.withColumn("fraud_probability", F.when(F.col("latency_ms") > 190, F.col("fraud_probability") + 1).otherwise(F.col("fraud_probability")))
    kept = tables.transactions(spark, folder).where(F.col("txn_timestamp") < _at("2024-01-29 00:00:00"))
    known = tables.labels(spark, folder)
    copies = F.when(F.col("delay_hours") > 7.5, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    doubled = known.withColumn("copy", F.explode(copies)).drop("copy")
    return checks.integrity_report(kept, p, doubled)


# -- sinks -------------------------------------------------------------------------------


@query
def insert_ignore(spark, folder):
    rows = tables.transactions(spark, folder).select("txn_id", "amount", "txn_timestamp")
    target = rows.where(F.col("txn_timestamp") < _at("2024-01-15 00:00:00"))
    incoming = rows.where(F.col("txn_timestamp") >= _at("2024-01-10 00:00:00"))
    again = incoming.withColumn("amount", F.col("amount") + 1)
    return sinks.insert_ignore(target, incoming.unionByName(again), ["txn_id"], [F.asc("amount")])


@query
def log_predictions(spark, folder):
    txns = tables.transactions(spark, folder).select("txn_id", "amount")
    p = tables.predictions(spark, folder).select("txn_id", "fraud_probability", "model_version")
    scored = p.join(txns, "txn_id").select("txn_id", "amount", "fraud_probability", "model_version")
    stored, logged = sinks.log_predictions(
        txns.where("amount < 100"), p.where("model_version = '7'"), scored.where("model_version = '8'"), p.columns
    )
    a = stored.agg(F.count(F.lit(1)).alias("rows"), F.sum("amount").alias("total")).withColumn("table", F.lit("transactions"))
    b = logged.agg(F.count(F.lit(1)).alias("rows"), F.sum("fraud_probability").alias("total")).withColumn("table", F.lit("predictions"))
    return a.unionByName(b)


@query
def backfill_attributions(spark, folder):
    p = tables.predictions(spark, folder).select("txn_id", "is_flagged").withColumn("top_features", F.lit(None).cast("string"))
    late = tables.transactions(spark, folder).where("amount > 300").select(
        "txn_id", F.concat(F.lit("log_amount:"), F.col("merchant_category")).alias("top_features")
    )
    return sinks.backfill(p, late, "txn_id", ["top_features"])


@query
def stamp_label_time(spark, folder):
    p = tables.predictions(spark, folder).select("txn_id", "model_version")
    new = tables.labels(spark, folder).select("txn_id", F.col("confirmed_at").alias("label_confirmed_at"))
    return sinks.backfill(p, new, "txn_id", ["label_confirmed_at"])


# -- labels ------------------------------------------------------------------------------


@query
def unlabeled_backlog(spark, folder):
    rows = lb.unlabeled_backlog(tables.transactions(spark, folder), tables.labels(spark, folder), _at(NOW))
    return rows.select("txn_id", "user_id", "amount", "txn_timestamp")


def _matured(spark: SparkSession, folder: str) -> DataFrame:
    backlog = lb.unlabeled_backlog(tables.transactions(spark, folder), tables.labels(spark, folder), _at(NOW), batch=None)
    return lb.matured(backlog, _at(NOW))


@query
def matured_txns(spark, folder):
    return _matured(spark, folder).select("txn_id", "age_hours", "delay_hours")


@query
def rule_score(spark, folder):
    score = signals.rule_score("amount", "ip_country", "user_id", "channel", "merchant_category")
    return tables.transactions(spark, folder).select("txn_id", score.alias("score"))


@query
def rule_labels(spark, folder):
    return lb.rule_labels(_matured(spark, folder), _at(NOW))


@query
def write_labels(spark, folder):
    stored, stamped = lb.write_labels(
        tables.labels(spark, folder),
        tables.predictions(spark, folder).withColumn("label_confirmed_at", F.lit(None).cast("timestamp")),
        lb.rule_labels(_matured(spark, folder), _at(NOW)),
    )
    a = stored.agg(F.count(F.lit(1)).alias("rows"), F.count_if("is_fraud").alias("marked"))
    b = stamped.agg(F.count(F.lit(1)).alias("rows"), F.count("label_confirmed_at").alias("marked"))
    return a.withColumn("table", F.lit("labels")).unionByName(b.withColumn("table", F.lit("predictions")))


@query
def label_interval_join(spark, folder):
    known = tables.labels(spark, folder)
    late = known.withColumn("confirmed_at", F.col("confirmed_at") + F.make_dt_interval(secs=F.col("delay_hours") * 1200))
    rows = joins.interval_join(tables.transactions(spark, folder), late, 1, 4)
    return rows.select("txn_id", "is_fraud", "txn_timestamp", "confirmed_at")


# -- training and evaluation -------------------------------------------------------------


@query
def training_frame(spark, folder):
    return scoring.training_frame(snapshots(spark, folder), tables.labels(spark, folder))


@query
def class_balance(spark, folder):
    return mt.class_balance(tables.labels(spark, folder), "is_fraud", 1000)


@query
def stratified_split(spark, folder):
    return scoring.stratified_split(tables.labels(spark, folder).select("txn_id", "is_fraud"))


@query
def threshold_sweep(spark, folder):
    scored = _scored_labels(spark, folder)
    table = mt.threshold_table(scored, "fraud_probability", "is_fraud")
    return table.withColumn("chosen", mt.best_threshold(table).select("best_threshold").scalar() == F.col("threshold"))


@query
def auc(spark, folder):
    return mt.auc(_scored_labels(spark, folder), "fraud_probability", "is_fraud", ["model_version"])


@query
def average_precision(spark, folder):
    return mt.average_precision(_scored_labels(spark, folder), "fraud_probability", "is_fraud", ["model_version"])


@query
def log_loss(spark, folder):
    return mt.log_loss(_scored_labels(spark, folder), "fraud_probability", "is_fraud")


@query
def classification_metrics(spark, folder):
    return mt.classification_metrics(_scored_labels(spark, folder), "fraud_probability", "is_fraud")


@query
def confusion_counts(spark, folder):
    return routing.confusion_counts(tables.predictions(spark, folder), tables.labels(spark, folder))


@query
def flag_predictions(spark, folder):
    limits = rg.thresholds(tables.model_registry(spark, folder))
    rows = scoring.flag_predictions(tables.predictions(spark, folder), limits)
    return rows.select("txn_id", "model_version", "threshold", "is_flagged")


@query
def shadow_scores(spark, folder):
    p = tables.predictions(spark, folder).select("txn_id", "fraud_probability", "model_version")
    other = p.withColumns({"fraud_probability": F.col("fraud_probability") / 2, "model_version": F.lit("9")})
    return routing.shadow_scores(p, other)


@query
def attributions(spark, folder):
    rows = scoring.attributions(snapshots(spark, folder), WEIGHTS)
    return rows.select("txn_id", *[signals.rounded(F.col(f"phi_{c}"), 6).alias(f"phi_{c}") for c in FEATURE_COLUMNS])


@query
def attribution_summary(spark, folder):
    summary = scoring.attribution_summary(scoring.attributions(snapshots(spark, folder), WEIGHTS))
    return summary.withColumn("mean_abs_attribution", signals.rounded(F.col("mean_abs_attribution"), 6))


@query
def topk_attributions(spark, folder):
    """The five strongest attributions of every flagged transaction."""
    explained = scoring.attributions(snapshots(spark, folder), WEIGHTS)
    flagged = tables.predictions(spark, folder).where("is_flagged").select("txn_id")
    top = scoring.top_attributions(explained).join(flagged, "txn_id")
    rows = top.select("txn_id", F.posexplode("top_features").alias("place", "t"))
    size = signals.rounded(F.col("t.attribution"), 6)
    return rows.select("txn_id", "place", "t.feature", size.alias("attribution"), "t.feature_value")


def _training_frame(spark: SparkSession, folder: str) -> DataFrame:
    frame = scoring.stratified_split(scoring.training_frame(snapshots(spark, folder), tables.labels(spark, folder)))
    return persist_table(frame, "training_frame")


# The given tables start at a few hundred labeled rows.
FEW_ROWS = 200


def fitted_linear(spark: SparkSession, folder: str):
    return scoring.train_linear(_training_frame(spark, folder), min_rows=FEW_ROWS)


@query
def train_gbt(spark, folder):
    """Test-set measures of a model fitted on the labeled snapshots."""
    frame = _training_frame(spark, folder)
    trees = scoring.train_gbt(frame, min_rows=FEW_ROWS)
    held = scoring.score(trees, frame.where("part = 'test'"), "gbt")
    ranked = mt.auc(held, "fraud_probability", "is_fraud").scalar()
    return mt.classification_metrics(held, "fraud_probability", "is_fraud").withColumn("auc", ranked)


@query
def score_batch(spark, folder):
    """Every transaction scored with the snapshot known at its instant."""
    linear = fitted_linear(spark, folder)
    vectors = signals.vector_columns(_asof(spark, folder, ["snapshot_key", *FEATURE_COLUMNS]))
    scored = scoring.score(linear, vectors, "linear")
    return scored.select("txn_id", "fraud_probability", "is_flagged", "model_version", "is_cold_start")


# -- registry ----------------------------------------------------------------------------


def _registry(spark: SparkSession, folder: str) -> DataFrame:
    """The stored registry, one row per model version."""
    return _stored(spark, folder, "model_registry", lambda: tables.model_registry(spark, folder))


def _flat(df: DataFrame) -> DataFrame:
    rest = [c for c in df.columns if c != "metrics"]
    return df.select(*rest, *[rg.metric(m).alias(m) for m in ("auc", "pr_auc", "best_threshold")])


def _challenger(spark: SparkSession, folder: str) -> DataFrame:
    """A retrained version 9 that takes over the measures of version 8."""
    old = _registry(spark, folder).where("model_version = '8'")
    new = {"model_version": F.lit("9"), "model_uri": F.lit(f"models:/{MODEL_NAME}/retrained")}
    return small_table(old.withColumns(new))


@query
def registry_upsert(spark, folder):
    return _flat(sinks.upsert(_registry(spark, folder), _challenger(spark, folder), ["model_name", "model_version"]))


@query
def retire_models(spark, folder):
    return _flat(rg.retire_models(_registry(spark, folder)))


@query
def registry_update(spark, folder):
    return _flat(rg.register(_registry(spark, folder), _challenger(spark, folder)))


@query
def serving_models(spark, folder):
    return _flat(rg.serving_models(_registry(spark, folder)))


@query
def active_model(spark, folder):
    return rg.active_model(_registry(spark, folder))


@query
def registry_delta(spark, folder):
    registry = _registry(spark, folder)
    current = registry.where("model_version in ('7', '8')")
    return rg.registry_delta(current, rg.serving_models(registry))


@query
def promotion_decision(spark, folder):
    return rg.promotion_decision(_registry(spark, folder), _challenger(spark, folder), force=False)


# -- routing -----------------------------------------------------------------------------


def _serving_7_8(spark: SparkSession, folder: str) -> DataFrame:
    slots = F.when(F.col("model_version") == "8", 0).otherwise(1)
    return _registry(spark, folder).where("model_version in ('7', '8', '9')").withColumn("slot", slots)


@query
def bandit_posteriors(spark, folder):
    return routing.bandit_posteriors(_serving_7_8(spark, folder), tables.predictions(spark, folder), tables.labels(spark, folder))


@query
def ab_route(spark, folder):
    txns = tables.transactions(spark, folder).select("txn_id")
    return routing.split_route(txns, ["8", "7"], 30.0)


@query
def thompson_route(spark, folder):
    serving = _serving_7_8(spark, folder).where("model_version in ('7', '8')")
    posteriors = routing.bandit_posteriors(serving, tables.predictions(spark, folder), tables.labels(spark, folder))
    return routing.route(tables.transactions(spark, folder).select("txn_id"), posteriors)


@query
def serving_modes(spark, folder):
    """The models that score each transaction under either mode."""
    serving = _serving_7_8(spark, folder).where("model_version in ('7', '8')")
    posteriors = routing.bandit_posteriors(serving, tables.predictions(spark, folder), tables.labels(spark, folder))
    posteriors, txns = small_table(posteriors), tables.transactions(spark, folder).select("txn_id")
    modes = [routing.assign(txns, posteriors, m).withColumn("mode", F.lit(m)) for m in (routing.AB_TEST, routing.SHADOW)]
    return modes[0].unionByName(modes[1])


# -- graph -------------------------------------------------------------------------------


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    """The stored graph."""
    return _stored(spark, folder, "edges", lambda: graph.build_edges(tables.transactions(spark, folder)))


def _flagged(spark: SparkSession, folder: str) -> DataFrame:
    return graph.flagged_users(tables.labels(spark, folder), tables.transactions(spark, folder), _at(FLAGGED_BY))


@query
def graph_edges(spark, folder):
    return graph.build_edges(tables.transactions(spark, folder))


@query
def flagged_users(spark, folder):
    return _flagged(spark, folder)


@query
def shared_device_count(spark, folder):
    return graph.shared_device_count(_edges(spark, folder))


def _few_devices(spark: SparkSession, folder: str) -> DataFrame:
    """Transactions of a population that shares seven devices, in all combinations."""
    rows = tables.transactions(spark, folder, keep_event_id=True)
    return rows.withColumn("device_id", F.concat(F.lit("dev_"), (F.col("event_id") % 7).cast("string"))).drop("event_id")


@query
def busy_device_count(spark, folder):
    return graph.shared_device_count(graph.build_edges(_few_devices(spark, folder)))


@query
def busy_device_count_asof(spark, folder):
    txns = _few_devices(spark, folder)
    return _devices_asof(txns, persist_table(graph.build_edges(txns), "few_devices"))


@query
def shared_device_count_asof(spark, folder):
    return _devices_asof(tables.transactions(spark, folder), _edges(spark, folder))


def _devices_asof(txns: DataFrame, edges: DataFrame) -> DataFrame:
    events, arrivals = graph.shared_device_events(edges)
    rows = bh.behaviour(txns, families=(), user_events=events.drop("busy_set"), event_totals=["devices_met"])
    if arrivals is not None:
        rows = graph.add_busy_members(rows, arrivals, times=txns)
    return rows.select("txn_id", F.col("devices_met").alias("shared_device_count"))


@query
def merchant_fraud_count(spark, folder):
    return graph.merchant_fraud_count(_edges(spark, folder), _flagged(spark, folder))


@query
def hop_distance(spark, folder):
    """Over devices alone, where distances differ."""
    return graph.hop_distance(_edges(spark, folder), _flagged(spark, folder), ["USED_DEVICE"])


@query
def hop_distance_all(spark, folder):
    return graph.hop_distance(_edges(spark, folder), _flagged(spark, folder))


# -- drift -------------------------------------------------------------------------------


def _psi_parts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    base, live = _halves(shifted_snapshots(spark, folder))
    base, live = drift.long_form(base), drift.long_form(live)
    return base, live, drift.quantile_edges(base)


@query
def psi_edges(spark, folder):
    _, _, edges = _psi_parts(spark, folder)
    return edges.select("feature", F.posexplode("edges").alias("place", "edge"))


@query
def psi_bucket_probs(spark, folder):
    _, live, edges = _psi_parts(spark, folder)
    return drift.bucket_probs(live, edges)


def _feature_psi(spark: SparkSession, folder: str) -> DataFrame:
    base, live, edges = _psi_parts(spark, folder)
    return drift.psi(drift.bucket_probs(base, edges), drift.bucket_probs(live, edges))


@query
def feature_psi(spark, folder):
    return _feature_psi(spark, folder).withColumn("band", drift.psi_band(F.col("psi")))


@query
def windowed_psi(spark, folder):
    """The last hours against the three days before the newest active model was created."""
    rows = snapshots(spark, folder)
    base = drift.long_form(drift.reference_window(rows, rg.active_model(_registry(spark, folder)), "txn_timestamp"))
    live = drift.long_form(drift.live_window(rows, _at(NOW), "txn_timestamp"))
    edges = drift.quantile_edges(base)
    found = drift.psi(drift.bucket_probs(base, edges), drift.bucket_probs(live, edges))
    return found.withColumn("band", drift.psi_band(F.col("psi")))


@query
def drift_summary(spark, folder):
    return drift.drift_summary(_feature_psi(spark, folder))


def _baseline(spark: SparkSession, folder: str) -> DataFrame:
    base, _ = _halves(shifted_snapshots(spark, folder))
    return drift.baseline(base, "8")


# The windows of the smallest tables hold few rows; the operator's own limit is 200.
FEW_LIVE_ROWS = 20


def _windowed_baseline(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """What is stored for the newest active model: edges and shares of its features, and the distribution of its scores."""
    model = rg.active_model(_registry(spark, folder))
    version = model.select("model_version").scalar()
    rows = drift.reference_window(snapshots(spark, folder), model, "txn_timestamp")
    scored = drift.reference_window(tables.predictions(spark, folder), model, "scored_at")
    features = _stored(spark, folder, "drift_baseline", lambda: drift.baseline(rows, version, min_rows=FEW_LIVE_ROWS))
    return features, _stored(spark, folder, "drift_scores", lambda: drift.baseline_scores(scored, version))


@query
def drift_baseline(spark, folder):
    """Over the three days before the newest active model."""
    rows, _ = _windowed_baseline(spark, folder)
    return rows.select(
        "model_version", "feature_name", F.size("bucket_edges").alias("edges"), F.posexplode("bucket_probs").alias("bucket", "prob")
    )


@query
def baseline_scores(spark, folder):
    """The stored scores of the same days."""
    return _windowed_baseline(spark, folder)[1]


@query
def baseline_store(spark, folder):
    """Storing the same baseline twice leaves one row per feature, and the version complete."""
    rows = _baseline(spark, folder)
    keys = ["model_version", "feature_name"]
    stored = sinks.insert_ignore(rows.where("feature_name <> 'log_amount'"), rows, keys)
    done = drift.baseline_complete(stored, "8").scalar()
    return stored.select(*keys, F.size("bucket_probs").alias("buckets")).withColumn("complete", done)


def _score_halves(spark: SparkSession, folder: str) -> DataFrame:
    p = tables.predictions(spark, folder)
    return p.select("fraud_probability", (F.col("scored_at") >= _at(SPLIT_AT)).alias("is_live"))


@query
def ks_statistic(spark, folder):
    return mt.ks_two_sample(_score_halves(spark, folder), "fraud_probability", "is_live").select("ks_statistic")


@query
def ks_pvalue(spark, folder):
    return mt.ks_two_sample(_score_halves(spark, folder), "fraud_probability", "is_live")


@query
def last_retrain(spark, folder):
    return drift.last_retrain(tables.drift_events(spark, folder))


@query
def retrain_decision(spark, folder):
    """Every past check judged again at the end of the data, with a cooldown of two days."""
    events = tables.drift_events(spark, folder)
    past = events.select("checked_at", "model_version", "drift_detected")
    return drift.retrain_decision(past, events, _at(NOW), 2 * 24 * 60)


def _drift_check(spark: SparkSession, folder: str) -> DataFrame:
    """The last six hours against the stored baseline of the newest active model."""
    features, scores = _windowed_baseline(spark, folder)
    live = drift.live_window(snapshots(spark, folder), _at(NOW), "txn_timestamp")
    live_scores = drift.live_window(tables.predictions(spark, folder), _at(NOW), "scored_at")
    version = rg.active_model(_registry(spark, folder)).select("model_version").scalar()
    checked = drift.drift_check(
        features, live, scores, live_scores, tables.drift_events(spark, folder), version, _at(NOW), min_rows=FEW_LIVE_ROWS
    )
    # The map as text that any SQL engine can build.
    entry = F.transform(F.map_entries("feature_psi"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("decimal(10,5)").cast("string")))
    return checked.withColumn("feature_psi", F.array_join(entry, ","))


@query
def drift_check(spark, folder):
    return _drift_check(spark, folder)


@query
def drift_event(spark, folder):
    """The event log, with all columns of an event, after appending the newest check."""
    events = tables.drift_events(spark, folder).withColumns(
        {
            "feature_psi": F.lit(None).cast("string"),
            "prediction_ks_statistic": F.lit(None).cast("double"),
            "prediction_ks_pvalue": F.lit(None).cast("double"),
        }
    )
    return sinks.insert_ignore(events, persist_table(_drift_check(spark, folder), "drift_event"), ["checked_at", "model_version"])


# -- reports -----------------------------------------------------------------------------


@query
def stats_overview(spark, folder):
    return reports.stats_overview(tables.predictions(spark, folder), _at(NOW), 24)


@query
def fraud_rate_trend(spark, folder):
    return reports.fraud_rate_trend(tables.predictions(spark, folder), _at(NOW), 24)


@query
def flag_rate_pct(spark, folder):
    return reports.flag_rate_pct(tables.predictions(spark, folder), _at(NOW), 24)


@query
def latency_timeseries(spark, folder):
    return reports.latency_timeseries(tables.predictions(spark, folder), _at(NOW), 24)


@query
def latency_percentiles(spark, folder):
    return reports.latency_percentiles(tables.predictions(spark, folder), ["model_version"])


@query
def latency_summary(spark, folder):
    return reports.latency_summary(tables.predictions(spark, folder))


@query
def latency_sla(spark, folder):
    return reports.latency_sla(tables.predictions(spark, folder))


@query
def traffic_split(spark, folder):
    return reports.traffic_split(tables.predictions(spark, folder))


@query
def traffic_split_by_id(spark, folder):
    return reports.traffic_split(tables.predictions(spark, folder), 1000, ("txn_id",))


@query
def recent_flag_rate(spark, folder):
    return reports.recent_flag_rate(tables.predictions(spark, folder))


@query
def recent_predictions(spark, folder):
    return reports.recent_predictions(tables.predictions(spark, folder))


@query
def recent_drift_events(spark, folder):
    return reports.recent_drift_events(tables.drift_events(spark, folder))


@query
def recent_models(spark, folder):
    return _flat(reports.recent_models(_registry(spark, folder)))


@query
def ab_metrics(spark, folder):
    return reports.ab_metrics(tables.predictions(spark, folder), tables.labels(spark, folder), _at(NOW), 24)


@query
def ab_compare(spark, folder):
    return reports.ab_compare(tables.predictions(spark, folder), tables.labels(spark, folder), _at(NOW), 24)


@query
def ab_metrics_all(spark, folder):
    return reports.ab_metrics_all(tables.predictions(spark, folder), tables.labels(spark, folder))


@query
def tumbling_user_24h(spark, folder):
    return reports.user_windows(tables.transactions(spark, folder))


@query
def sliding_user_24h(spark, folder):
    return reports.user_windows(tables.transactions(spark, folder), "24 hours", "1 hour")
