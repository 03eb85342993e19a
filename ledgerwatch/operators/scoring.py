"""Training sets, models, scores and attributions."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ledgerwatch.functions.signals import hash_uniform, ratio
from ledgerwatch.operators.joins import dedup_latest
from ledgerwatch.operators.metrics import class_balance
from ledgerwatch.operators.ordering import percentiles
from ledgerwatch.schema import DEFAULT_THRESHOLD, FEATURE_COLUMNS, MIN_LABELED_ROWS


def training_frame(snapshots: DataFrame, labels: DataFrame, features: list[str] = FEATURE_COLUMNS) -> DataFrame:
    """Newest snapshot of every labeled transaction as numbers; rows with gaps are dropped."""
    newest = dedup_latest(snapshots, ["txn_id"], [F.desc("computed_at")])
    numbers = [F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in features]
    joined = newest.join(labels.select("txn_id", "is_fraud"), "txn_id")
    return joined.select("txn_id", *numbers, "is_fraud").na.drop(subset=[*features, "is_fraud"])


def stratified_split(
    df: DataFrame, label: str = "is_fraud", key: str = "txn_id", test: float = 0.1, val: float = 0.2, seed: int = 42
) -> DataFrame:
    """Adds ``part``: test, val or train, with exact shares within each class.

    Rows are ranked by a hash of their key. The class quantiles of that hash, one row
    per class, replace the ranking.
    """
    drawn = df.withColumn("_u", hash_uniform(key, str(seed)))
    cuts = percentiles(drawn.select(label, "_u"), "_u", {"_test": test, "_held": test + val}, [label])
    part = F.when(F.col("_u") <= F.col("_test"), "test").when(F.col("_u") <= F.col("_held"), "val").otherwise("train")
    return drawn.join(F.broadcast(cuts), label).withColumn("part", part).select(*df.columns, "part")


def _weighted(train: DataFrame, label: str, min_rows: int) -> DataFrame:
    """Training rows with a numeric label and class weights; refuses unusable data."""
    state = class_balance(train.where("part = 'train'"), label, min_rows).first()
    if state.verdict == "too_few_rows":
        raise ValueError(f"only {state.rows} labeled rows, need {min_rows}")
    if state.verdict == "single_class":
        raise ValueError(f"training data has only one class (fraud rate {state.fraud_rate})")
    weight = F.when(F.col(label), F.lit(state.positive_weight)).otherwise(F.lit(1.0))
    return train.withColumns({"label": F.col(label).cast("double"), "weight": weight})


def train_gbt(
    frame: DataFrame,
    label: str = "is_fraud",
    features: list[str] = FEATURE_COLUMNS,
    min_rows: int = MIN_LABELED_ROWS,
    rounds: int = 300,
    depth: int = 5,
    step: float = 0.05,
    subsample: float = 0.8,
    seed: int = 42,
) -> PipelineModel:
    """Boosted trees on the train part, stopped when the validation part no longer gains.

    ``frame`` comes from :func:`stratified_split`.
    """
    rows = _weighted(frame.where("part <> 'test'"), label, min_rows)
    rows = rows.withColumn("held_out", F.col("part") == "val")
    trees = GBTClassifier(
        featuresCol="features", labelCol="label", weightCol="weight", validationIndicatorCol="held_out",
        maxIter=rounds, maxDepth=depth, stepSize=step, subsamplingRate=subsample, minInstancesPerNode=2,
        validationTol=0.001, seed=seed,
    )
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), trees]).fit(rows)


def train_linear(
    frame: DataFrame, label: str = "is_fraud", features: list[str] = FEATURE_COLUMNS, min_rows: int = MIN_LABELED_ROWS
) -> PipelineModel:
    rows = _weighted(frame.where("part = 'train'"), label, min_rows)
    linear = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", regParam=0.001)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), linear]).fit(rows)


def score(model: PipelineModel, df: DataFrame, model_version: str, threshold: float | Column = DEFAULT_THRESHOLD) -> DataFrame:
    """Adds ``fraud_probability``, ``is_flagged`` and ``model_version``."""
    scored = model.transform(df).withColumn("fraud_probability", vector_to_array("probability")[1])
    return scored.select(
        *df.columns,
        "fraud_probability",
        (F.col("fraud_probability") >= threshold).alias("is_flagged"),
        F.lit(model_version).alias("model_version"),
    )


def flag_predictions(scores: DataFrame, thresholds: DataFrame, default: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Flag by the threshold of the row's model version, or the default without one.

    The thresholds, one row per registered model, are joined without a hint: Spark
    broadcasts them by their actual size.
    """
    limit = F.coalesce("best_threshold", F.lit(default))
    return scores.join(thresholds, "model_version", "left").select(
        *[c for c in scores.columns if c != "is_flagged"],
        limit.alias("threshold"),
        (F.col("fraud_probability") >= limit).alias("is_flagged"),
    )


def linear_weights(model: PipelineModel, features: list[str] = FEATURE_COLUMNS) -> dict[str, float]:
    return dict(zip(features, map(float, model.stages[-1].coefficients)))


def attributions(df: DataFrame, weights: dict[str, float], background: DataFrame | None = None) -> DataFrame:
    """Adds ``phi_<feature>``: the exact Shapley value of a linear score, weight times distance from the mean.

    Means are taken of exact sums to the twelfth decimal place, so they do not depend on the order of the rows.
    """

    def mean(c: str) -> Column:
        return ratio(F.sum(F.col(c).cast("decimal(38,12)")), F.count(c))

    means = (background if background is not None else df).agg(F.struct(*[mean(c).alias(c) for c in weights]).alias("means"))
    shifted = df.withColumn("_means", means.scalar())
    phi = {f"phi_{c}": F.lit(w) * (F.col(c).cast("double") - F.col(f"_means.{c}")) for c, w in weights.items()}
    return shifted.withColumns(phi).drop("_means")


def attribution_summary(explained: DataFrame, features: list[str] = FEATURE_COLUMNS) -> DataFrame:
    """Mean absolute attribution per feature."""
    means = explained.agg(*[F.avg(F.abs(F.col(f"phi_{c}"))).alias(c) for c in features])
    return means.unpivot([], features, "feature", "mean_abs_attribution")


def top_attributions(explained: DataFrame, features: list[str] = FEATURE_COLUMNS, k: int = 5) -> DataFrame:
    """Adds ``top_features``: the ``k`` attributions of largest size, ties in contract order."""
    entries = F.array(
        *[
            F.struct(
                (-F.round(F.abs(F.col(f"phi_{c}")), 9)).alias("size"),
                F.lit(i).alias("place"),
                F.lit(c).alias("feature"),
                F.col(f"phi_{c}").alias("attribution"),
                F.col(c).cast("double").alias("feature_value"),
            )
            for i, c in enumerate(features)
        ]
    )
    top = F.transform(
        F.slice(F.array_sort(entries), 1, k), lambda e: F.struct(e.feature, e.attribution, e.feature_value)
    )
    return explained.withColumn("top_features", top)
