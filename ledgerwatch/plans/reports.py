"""Operational reports. ``as_of`` stands for the current time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerwatch.functions.signals import inference_ms, ratio, rounded, sla_met
from ledgerwatch.operators.metrics import confusion
from ledgerwatch.operators.ordering import percentiles, selected
from ledgerwatch.schema import SLA_MS


def _recent(df: DataFrame, as_of, hours: float, ts: str = "scored_at") -> DataFrame:
    return df.where(F.col(ts) >= F.lit(as_of) - F.make_dt_interval(secs=F.lit(hours * 3600)))


def _count(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def latency_percentiles(predictions: DataFrame, keys: list[str] = (), column: str = "latency_ms") -> DataFrame:
    return percentiles(predictions, column, {"p50": 0.5, "p95": 0.95, "p99": 0.99}, list(keys))


def _mean_sums(name: str, value: Column) -> dict[str, Column]:
    """What a mean is made of, as totals."""
    return {f"{name}_sum": value.cast("double"), f"{name}_n": F.when(value.isNotNull(), 1).otherwise(0)}


def stats_overview(predictions: DataFrame, as_of, hours: float = 1) -> DataFrame:
    recent = _recent(predictions, as_of, hours)
    latency, model = F.col("latency_ms"), inference_ms()
    measures = {"latency": (latency, {"p95": 0.95, "p99": 0.99}), "model": (model, {"p99_model": 0.99})}
    totals = {
        "total_predictions": F.lit(1).cast("bigint"),
        "total_flagged": F.when(F.col("is_flagged"), 1).otherwise(0),
        "met": F.when(sla_met("latency_ms"), 1).otherwise(0),
        **_mean_sums("latency", latency),
        **_mean_sums("model", model),
    }
    found = selected(recent, measures, totals=totals)
    return found.select(
        F.coalesce("total_predictions", F.lit(0)).alias("total_predictions"),
        "total_flagged",
        rounded(ratio(F.col("latency_sum"), F.col("latency_n")), 2).alias("avg_latency_ms"),
        rounded(F.col("p95"), 2).alias("p95_latency_ms"),
        rounded(F.col("p99"), 2).alias("p99_latency_ms"),
        rounded(ratio(F.col("model_sum"), F.col("model_n")), 3).alias("avg_inference_ms"),
        rounded(F.col("p99_model"), 3).alias("p99_inference_ms"),
        (ratio(F.col("met"), F.col("total_predictions")) * 100).alias("sla_compliance_pct"),
    )


def _per_minute(predictions: DataFrame, as_of, hours: float) -> DataFrame:
    return _recent(predictions, as_of, hours).withColumn("minute", F.date_trunc("minute", "scored_at"))


def fraud_rate_trend(predictions: DataFrame, as_of, hours: float = 1, newest: int = 60) -> DataFrame:
    per_minute = _per_minute(predictions, as_of, hours).groupBy("minute").agg(
        F.count(F.lit(1)).alias("total"),
        _count(F.col("is_flagged")).alias("flagged"),
        rounded(F.avg("fraud_probability"), 4).alias("avg_prob"),
    )
    return per_minute.orderBy(F.desc("minute")).limit(newest)


def flag_rate_pct(predictions: DataFrame, as_of, hours: float = 1, newest: int = 60) -> DataFrame:
    trend = fraud_rate_trend(predictions, as_of, hours, newest)
    total = F.when(F.col("total") == 0, 1).otherwise(F.col("total"))
    return trend.select("minute", "total", "flagged", (ratio(F.col("flagged"), total) * 100).alias("fraud_rate_pct"))


def latency_timeseries(predictions: DataFrame, as_of, hours: float = 1, newest: int = 60) -> DataFrame:
    rows = _per_minute(predictions, as_of, hours)
    latency, model = F.col("latency_ms"), inference_ms()
    measures = {"latency": (latency, {"p95": 0.95, "p99": 0.99}), "model": (model, {"p99_model": 0.99})}
    totals = {**_mean_sums("latency", latency), **_mean_sums("model", model)}
    # One row per minute is left to be ordered.
    return selected(rows, measures, ["minute"], totals).orderBy(F.desc("minute")).limit(newest).select(
        "minute",
        rounded(ratio(F.col("latency_sum"), F.col("latency_n")), 2).alias("avg_ms"),
        rounded(F.col("p95"), 2).alias("p95_ms"),
        rounded(F.col("p99"), 2).alias("p99_ms"),
        rounded(ratio(F.col("model_sum"), F.col("model_n")), 3).alias("avg_inference_ms"),
        rounded(F.col("p99_model"), 3).alias("p99_inference_ms"),
    )


def latency_summary(df: DataFrame, column: str = "latency_ms", sla: float = SLA_MS) -> DataFrame:
    value = F.col(column)
    measures = {column: (value, {"p50": 0.5, "p95": 0.95, "p99": 0.99, "max": 1.0})}
    found = selected(df, measures, totals=_mean_sums("value", value))
    return found.select(
        F.coalesce("value_n", F.lit(0)).alias("requests"),
        ratio(F.col("value_sum"), F.col("value_n")).alias("mean"),
        "max", "p50", "p95", "p99",
        (F.col("p99") <= sla).alias("within_sla"),
    )


def latency_sla(predictions: DataFrame, newest: int = 500) -> DataFrame:
    rows = predictions.select("txn_id", "latency_ms").orderBy(F.desc("txn_id")).limit(newest)
    return rows.withColumn("sla_met", sla_met("latency_ms"))


def traffic_split(predictions: DataFrame, newest: int = 2000, by: tuple[str, ...] = ("scored_at", "txn_id")) -> DataFrame:
    rows = predictions.select("model_version", *by).orderBy(*[F.desc(c) for c in by]).limit(newest)
    return rows.groupBy("model_version").agg(F.count(F.lit(1)).alias("count"))


def recent_flag_rate(predictions: DataFrame, newest: int = 1000) -> DataFrame:
    rows = predictions.select("is_flagged", "scored_at", "txn_id").orderBy(F.desc("scored_at"), F.desc("txn_id"))
    return rows.limit(newest).agg((F.avg(F.col("is_flagged").cast("double")) * 100).alias("flag_rate_pct"))


def recent_predictions(predictions: DataFrame, newest: int = 25) -> DataFrame:
    return predictions.orderBy(F.desc("scored_at"), F.desc("txn_id")).limit(newest)


def recent_drift_events(events: DataFrame, newest: int = 10) -> DataFrame:
    return events.select(
        "checked_at",
        "model_version",
        "max_feature_psi",
        "mean_feature_psi",
        "drift_detected",
        "retrain_triggered",
        "retrain_skipped_reason",
    ).orderBy(F.desc("checked_at")).limit(newest)


def recent_models(registry: DataFrame, newest: int = 10) -> DataFrame:
    return registry.orderBy(F.desc("created_at")).limit(newest)


def ab_metrics(predictions: DataFrame, labels: DataFrame, as_of, hours: float = 24) -> DataFrame:
    """Per version over all recent predictions, labeled or not; undefined ratios are null."""
    joined = _recent(predictions, as_of, hours).join(labels.select("txn_id", "is_fraud"), "txn_id", "left")
    known, flagged = F.col("is_fraud").isNotNull(), F.col("is_flagged")
    fraud = known & F.col("is_fraud")
    return joined.groupBy("model_version").agg(
        F.count(F.lit(1)).alias("predictions"),
        ratio(_count(fraud & flagged), _count(known & flagged)).alias("precision"),
        ratio(_count(fraud & flagged), _count(fraud)).alias("recall"),
        rounded(F.avg("latency_ms"), 2).alias("avg_latency_ms"),
        rounded(F.avg(inference_ms()), 3).alias("avg_inference_ms"),
        _count(~known).alias("unlabelled_count"),
    )


def ab_compare(predictions: DataFrame, labels: DataFrame, as_of, hours: float = 24) -> DataFrame:
    """Per version over recent labeled predictions; undefined ratios are 0."""
    joined = _recent(predictions, as_of, hours).join(labels.select("txn_id", "is_fraud"), "txn_id")
    per_version = joined.groupBy("model_version").agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.avg("latency_ms").alias("avg_latency_ms"),
        _count(F.col("is_flagged")).alias("predicted_positives"),
        _count(F.col("is_fraud")).alias("actual_positives"),
        _count(F.col("is_flagged") & F.col("is_fraud")).alias("true_positives"),
    )
    hit = F.col("true_positives")
    return per_version.withColumns(
        {
            "precision": F.coalesce(ratio(hit, F.col("predicted_positives")), F.lit(0.0)),
            "recall": F.coalesce(ratio(hit, F.col("actual_positives")), F.lit(0.0)),
        }
    ).orderBy(F.desc("model_version"))


def ab_metrics_all(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Per version over all labeled predictions; undefined ratios are null."""
    joined = predictions.join(labels.select("txn_id", "is_fraud"), "txn_id")
    cells = joined.groupBy("model_version").agg(
        F.count(F.lit(1)).alias("count"), *confusion(F.col("is_flagged"), F.col("is_fraud"))
    )
    tp = F.col("tp")
    return cells.select(
        "model_version",
        "count",
        ratio(tp, tp + F.col("fp")).alias("precision"),
        ratio(tp, tp + F.col("fn")).alias("recall"),
    )


def user_windows(txns: DataFrame, length: str = "24 hours", slide: str | None = None) -> DataFrame:
    """Count, sum, mean and population deviation of amounts per user and event-time window.

    Works on tables and, behind a watermark, on streams.
    """
    span = F.window("txn_timestamp", length, slide) if slide else F.window("txn_timestamp", length)
    return txns.groupBy("user_id", span.alias("span")).agg(
        F.count(F.lit(1)).alias("txns"),
        F.sum("amount").alias("amount_sum"),
        F.avg("amount").alias("amount_mean"),
        F.stddev_pop("amount").alias("amount_std"),
    ).select("user_id", F.col("span.start").alias("window_start"), F.col("span.end").alias("window_end"),
             "txns", "amount_sum", "amount_mean", "amount_std")
