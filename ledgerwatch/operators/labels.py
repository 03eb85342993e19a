"""Label maturation: which transactions get their outcome in a pass, and what it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerwatch.functions.signals import hash_uniform, rounded, rule_score
from ledgerwatch.schema import LABEL_BATCH, LABEL_DELAY_HOURS
from ledgerwatch.sources.sinks import backfill, insert_ignore


def unlabeled_backlog(
    txns: DataFrame, labels: DataFrame, as_of, min_hours: float = LABEL_DELAY_HOURS[0], batch: int | None = LABEL_BATCH
) -> DataFrame:
    """Transactions without a label that are old enough, oldest first."""
    cut = F.lit(as_of) - F.make_dt_interval(secs=F.lit(min_hours * 3600))
    waiting = txns.where(F.col("txn_timestamp") <= cut).join(labels.select("txn_id"), "txn_id", "left_anti")
    return waiting.orderBy("txn_timestamp", "txn_id").limit(batch) if batch else waiting


def assigned_delay(low: float = LABEL_DELAY_HOURS[0], high: float = LABEL_DELAY_HOURS[1]) -> Column:
    """Hours until the outcome is known, drawn once per transaction from its id."""
    return low + (high - low) * hash_uniform("txn_id", "delay")


def matured(backlog: DataFrame, as_of, bounds: tuple[float, float] = LABEL_DELAY_HOURS) -> DataFrame:
    age = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("txn_timestamp")) / F.lit(3.6e9)
    return backlog.withColumns({"age_hours": age, "delay_hours": assigned_delay(*bounds)}).where(
        F.col("age_hours") >= F.col("delay_hours")
    )


def rule_labels(df: DataFrame, as_of, source: str = "simulated_chargeback") -> DataFrame:
    """Outcomes of matured transactions: fraud with the probability of the label rule."""
    score = rule_score("amount", "ip_country", "user_id", "channel", "merchant_category")
    return df.select(
        "txn_id",
        (hash_uniform("txn_id", "outcome") < score).alias("is_fraud"),
        F.lit(source).alias("label_source"),
        F.lit(as_of).cast("timestamp").alias("confirmed_at"),
        rounded(F.col("delay_hours"), 3).alias("delay_hours"),
    )


def write_labels(labels: DataFrame, predictions: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Insert the labels that are new, and stamp the time on all predictions of their transactions."""
    stamped = backfill(
        predictions,
        new.select("txn_id", F.col("confirmed_at").alias("label_confirmed_at")),
        "txn_id",
        ["label_confirmed_at"],
    )
    return insert_ignore(labels, new, ["txn_id"]), stamped


def label_pass(txns: DataFrame, labels: DataFrame, as_of, batch: int | None = LABEL_BATCH) -> DataFrame:
    """The labels one pass confirms."""
    return rule_labels(matured(unlabeled_backlog(txns, labels, as_of, batch=batch), as_of), as_of)
