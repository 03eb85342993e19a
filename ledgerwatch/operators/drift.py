"""Population drift of features (PSI) and of scores (KS), and the decision to retrain.

All features are handled in one pass over a long (feature, value) form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerwatch.functions.signals import rounded
from ledgerwatch.operators.metrics import ks_of_counts
from ledgerwatch.operators.ordering import percentiles
from ledgerwatch.schema import (
    BASELINE_HOURS,
    DRIFT_MIN_ROWS,
    FEATURE_COLUMNS,
    LIVE_HOURS,
    PSI_BUCKETS,
    PSI_DRIFT,
    PSI_FLOOR,
    PSI_WARN,
    RETRAIN_COOLDOWN_MINUTES,
)

from ledgerwatch.session import small_table


def _hours(n: int) -> Column:
    return F.make_dt_interval(hours=F.lit(n))


def reference_window(df: DataFrame, model: DataFrame, ts: str, hours: int = BASELINE_HOURS) -> DataFrame:
    """Rows of the ``hours`` before the model, a table of one row, was created; none without a model."""
    created = model.select("created_at").scalar()
    return df.where((F.col(ts) >= created - _hours(hours)) & (F.col(ts) < created))


def live_window(df: DataFrame, as_of, ts: str, hours: int = LIVE_HOURS) -> DataFrame:
    """Rows of the last ``hours`` up to ``as_of``."""
    return df.where((F.col(ts) >= F.lit(as_of) - _hours(hours)) & (F.col(ts) <= F.lit(as_of)))


def long_form(df: DataFrame, features: list[str] = FEATURE_COLUMNS) -> DataFrame:
    values = df.select(*[F.col(c).cast("double").alias(c) for c in features])
    return values.unpivot([], features, "feature", "value")


def quantile_edges(values: DataFrame, buckets: int = PSI_BUCKETS) -> DataFrame:
    """Inner bucket edges per feature: the distinct quantiles without the ends, which stay open.

    A constant feature gets its value as the one edge; a feature whose quantiles are
    only its two extremes gets none, and so a single bucket.
    """
    shares = {f"q{i}": i / buckets for i in range(buckets + 1)}
    found = percentiles(values, "value", shares, ["feature"])
    found = found.select("feature", F.array_sort(F.array_distinct(F.array(*shares))).alias("edges"))
    inner = F.slice("edges", F.lit(2), F.greatest(F.size("edges") - 2, F.lit(0)))
    chosen = F.when(F.size("edges") == 1, F.col("edges")).otherwise(inner)
    # Eleven numbers per feature, used several times over: pinned.
    return small_table(found.select("feature", chosen.alias("edges")))


def category_edges(values: DataFrame, max_values: int = 1000) -> DataFrame:
    """Edges at every value but the smallest, for features with few values; sees shifts that
    quantile edges of a rare 0/1 feature cannot. Not the default; refuses other features."""
    values = values.select("feature", "value").distinct()
    sizes = values.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    wide = [r.feature for r in sizes.where(F.col("n") > max_values).collect()]
    if wide:
        raise ValueError(f"more than {max_values} values, use quantile edges: {wide}")
    found = values.groupBy("feature").agg(F.array_sort(F.collect_set("value")).alias("edges"))
    return found.select("feature", F.slice("edges", F.lit(2), F.size("edges")).alias("edges"))


def bucket_probs(values: DataFrame, edges: DataFrame) -> DataFrame:
    """Share of rows per feature and bucket ``[edge, next edge)``, floored, empty buckets included.

    ``edges`` has one row per feature of the contract, so it is small enough to broadcast.
    """
    bucket = F.size(F.filter("edges", lambda e: e <= F.col("value")))
    counts = values.join(F.broadcast(edges), "feature").groupBy("feature", bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    slots = edges.select("feature", F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("bucket"))
    totals = counts.groupBy("feature").agg(F.sum("rows").alias("total"))
    filled = slots.join(counts, ["feature", "bucket"], "left").join(totals, "feature", "left")
    share = F.coalesce(F.try_divide(F.col("rows").cast("double"), F.col("total")), F.lit(0.0))
    return filled.select("feature", "bucket", F.greatest(share, F.lit(PSI_FLOOR)).alias("prob"))


def psi(baseline: DataFrame, live: DataFrame) -> DataFrame:
    """Population stability index per feature from two tables of bucket probabilities."""
    both = baseline.withColumnRenamed("prob", "b").join(live.withColumnRenamed("prob", "l"), ["feature", "bucket"])
    b, l = F.col("b"), F.col("l")
    return both.groupBy("feature").agg(rounded(F.sum((l - b) * F.ln(l / b)), 5).alias("psi"))


def psi_band(value: Column) -> Column:
    return F.when(value >= PSI_DRIFT, "drift").when(value >= PSI_WARN, "watch").otherwise("stable")


def drift_summary(per_feature: DataFrame, threshold: float = PSI_DRIFT) -> DataFrame:
    top, mean = F.col("max_feature_psi"), F.col("mean_feature_psi")
    return per_feature.agg(F.max("psi").alias("max_feature_psi"), F.avg("psi").alias("mean_feature_psi")).select(
        top, mean, psi_band(top).alias("band"), ((top >= threshold) | (mean >= threshold)).alias("drift_detected")
    )


def baseline(df: DataFrame, model_version, features: list[str] = FEATURE_COLUMNS, min_rows: int = DRIFT_MIN_ROWS) -> DataFrame:
    """Edges and bucket probabilities to store for a model version; empty below ``min_rows`` rows."""
    enough = df.agg((F.count(F.lit(1)) >= min_rows).alias("enough")).scalar()
    values = long_form(df, features)
    edges = quantile_edges(values)
    entry = F.sort_array(F.collect_list(F.struct("bucket", "prob")))
    probs = bucket_probs(values, edges).groupBy("feature").agg(entry.alias("p"))
    return (
        edges.join(probs, "feature")
        .where(enough)
        .select(
            F.lit(model_version).alias("model_version"),
            F.col("feature").alias("feature_name"),
            F.col("edges").alias("bucket_edges"),
            F.col("p.prob").alias("bucket_probs"),
        )
    )


def baseline_scores(df: DataFrame, model_version, score: str = "fraud_probability") -> DataFrame:
    """The exact distribution of a model's scores, to store next to the edges: each score and how often it occurred.

    A later check reads this in place of the predictions of the baseline's time.
    """
    known = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.count(F.lit(1)).alias("n"))
    return known.select(F.lit(model_version).alias("model_version"), "score", "n")


def baseline_complete(stored: DataFrame, model_version: str, features: list[str] = FEATURE_COLUMNS) -> DataFrame:
    """Whether the stored baseline covers every feature, and so need not be computed again."""
    mine = stored.where(F.col("model_version") == model_version)
    known = F.count_distinct(F.when(F.col("feature_name").isin(features), F.col("feature_name")))
    return mine.agg((known == len(features)).alias("complete"))


def stored_probs(stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A stored baseline as edges and as bucket probabilities."""
    edges = stored.select(F.col("feature_name").alias("feature"), F.col("bucket_edges").alias("edges"))
    probs = stored.select(F.col("feature_name").alias("feature"), F.posexplode("bucket_probs").alias("bucket", "prob"))
    return edges, probs


def last_retrain(events: DataFrame) -> DataFrame:
    """When a retrain last succeeded; failed ones do not count."""
    return events.where("retrain_triggered").agg(F.max("checked_at").alias("last_retrain_at"))


def retrain_decision(checks: DataFrame, events: DataFrame, as_of, cooldown_minutes: int = RETRAIN_COOLDOWN_MINUTES) -> DataFrame:
    """Adds ``retrain_triggered`` and the reason why not, for one check at ``as_of``."""
    last = last_retrain(events.where(F.col("checked_at") <= F.lit(as_of))).scalar()
    resting = F.coalesce(F.lit(as_of) - last < F.make_dt_interval(mins=F.lit(cooldown_minutes)), F.lit(False))
    drifted = F.col("drift_detected")
    reason = f"last retrain less than {cooldown_minutes} minutes ago"
    return checks.withColumns(
        {
            "retrain_triggered": drifted & ~resting,
            "retrain_skipped_reason": F.when(drifted & resting, F.lit(reason)),
        }
    )


def drift_check(
    stored: DataFrame,
    live: DataFrame,
    stored_scores: DataFrame,
    live_scores: DataFrame,
    events: DataFrame,
    model_version,
    as_of,
    features: list[str] = FEATURE_COLUMNS,
    min_rows: int = DRIFT_MIN_ROWS,
) -> DataFrame:
    """One drift event: PSI of every feature against the stored baseline, KS of the scores, decision.

    ``stored_scores`` is the table of :func:`baseline_scores`. No row below ``min_rows`` live rows.
    """
    edges, base_probs = stored_probs(stored.where(F.col("model_version") == model_version))
    per_feature = psi(base_probs, bucket_probs(long_form(live, features), edges))
    as_map = F.map_from_entries(F.sort_array(F.collect_list(F.struct("feature", "psi"))))
    summary = drift_summary(per_feature)
    none, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    known = stored_scores.where(F.col("model_version") == model_version).select("score", F.col("n").alias("a"), none.alias("b"))
    scores = known.unionByName(live_scores.select(F.col("fraud_probability").alias("score"), none.alias("a"), one.alias("b")))
    ks = ks_of_counts(scores, "score", F.col("a"), F.col("b")).select(F.struct("ks_statistic", "ks_pvalue").alias("ks"))
    enough = live.agg((F.count(F.lit(1)) >= min_rows).alias("enough")).scalar()
    check = summary.where(enough).withColumns(
        {
            "feature_psi": per_feature.agg(as_map.alias("m")).scalar(),
            "ks": ks.scalar(),
            "model_version": F.lit(model_version),
            "checked_at": F.lit(as_of).cast("timestamp"),
        }
    )
    decided = retrain_decision(check, events, as_of)
    return decided.select(
        "checked_at",
        "model_version",
        "feature_psi",
        "max_feature_psi",
        "mean_feature_psi",
        F.col("ks.ks_statistic").alias("prediction_ks_statistic"),
        F.col("ks.ks_pvalue").alias("prediction_ks_pvalue"),
        "drift_detected",
        "retrain_triggered",
        "retrain_skipped_reason",
    )
