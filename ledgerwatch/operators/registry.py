"""The model registry: which models are active, which serve, and when to change them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerwatch.schema import KEEP_ACTIVE_MODELS, MODEL_NAME, SERVING_MODELS
from ledgerwatch.sources.sinks import upsert


def metric(name: str, metrics: str = "metrics") -> Column:
    return F.try_element_at(F.col(metrics), F.lit(name))


def _by_auc() -> list[Column]:
    return [metric("auc").desc_nulls_last(), F.desc("created_at")]


def _active(registry: DataFrame, name: str) -> DataFrame:
    return registry.where((F.col("model_name") == name) & F.col("is_active"))


def serving_models(registry: DataFrame, name: str = MODEL_NAME, n: int = SERVING_MODELS) -> DataFrame:
    """The best ``n`` active models by AUC, with their ``slot`` from 0."""
    top = _active(registry, name).orderBy(*_by_auc()).limit(n)
    slot = F.row_number().over(Window.partitionBy("model_name").orderBy(*_by_auc())) - 1
    return top.withColumn("slot", slot)


def active_model(registry: DataFrame, name: str = MODEL_NAME) -> DataFrame:
    """The newest active model, one row or none."""
    newest = F.max_by(F.struct("model_version", "created_at"), F.struct("created_at", "model_version"))
    return _active(registry, name).groupBy("model_name").agg(newest.alias("m")).select("model_name", "m.*")


def retire_models(registry: DataFrame, name: str = MODEL_NAME, keep: int = KEEP_ACTIVE_MODELS) -> DataFrame:
    """Deactivate all active models below the best ``keep`` by AUC."""
    best = _active(registry, name).orderBy(*_by_auc()).limit(keep).select("model_version", F.lit(True).alias("_best"))
    joined = registry.join(best, "model_version", "left")
    drop = (F.col("model_name") == name) & F.col("is_active") & F.col("_best").isNull()
    return joined.withColumn("is_active", F.col("is_active") & ~drop).select(*registry.columns)


def register(registry: DataFrame, new: DataFrame, name: str = MODEL_NAME) -> DataFrame:
    """Retire the weakest if the new model is to be active, then insert or replace it.

    Active models number at most one more than ``KEEP_ACTIVE_MODELS``.
    """
    activates = new.where("is_active").agg((F.count(F.lit(1)) > 0).alias("any")).scalar()
    retired = retire_models(registry, name).withColumnRenamed("is_active", "_after")
    keys = ["model_name", "model_version"]
    base = registry.join(retired.select(*keys, "_after"), keys)
    base = base.withColumn("is_active", F.when(activates, F.col("_after")).otherwise(F.col("is_active")))
    return upsert(base.select(*registry.columns), new, keys)


def registry_delta(current: DataFrame, target: DataFrame) -> DataFrame:
    """Versions to load and to unload; empty when both sets are equal."""
    now, then = current.select("model_version").distinct(), target.select("model_version").distinct()
    load = then.exceptAll(now).withColumn("action", F.lit("load"))
    return load.unionByName(now.exceptAll(then).withColumn("action", F.lit("unload")))


def promotion_decision(registry: DataFrame, challenger: DataFrame, force: bool = True, artifact_ok: bool = True) -> DataFrame:
    """Whether the challenger becomes active: forced, or better than the newest active model by PR-AUC."""
    champion = registry.join(active_model(registry).select("model_name", "model_version"), ["model_name", "model_version"])
    champion = champion.select("model_name", F.coalesce(metric("pr_auc"), F.lit(0.0)).alias("champion_pr_auc"))
    both = challenger.join(champion, "model_name", "left")
    pr_auc = F.coalesce(metric("pr_auc"), F.lit(0.0))
    better = F.col("champion_pr_auc").isNull() | (pr_auc > F.col("champion_pr_auc"))
    return both.select(
        "model_version",
        pr_auc.alias("challenger_pr_auc"),
        "champion_pr_auc",
        (F.lit(artifact_ok) & (F.lit(force) | better)).alias("promote"),
    )


def thresholds(registry: DataFrame) -> DataFrame:
    """Decision threshold per version, null where the model has none of its own."""
    return registry.select("model_version", metric("best_threshold").alias("best_threshold"))
