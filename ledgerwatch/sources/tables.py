"""Table scans and the mapping of the given tables to the transaction model.

``transactions``, ``labels``, ``predictions`` and so on derive from ``events``;
``FIXTURES.md`` states the mapping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerwatch.functions.signals import home_country, rule_score
from ledgerwatch.schema import HOME_COUNTRIES, MODEL_NAME


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int) -> DataFrame:
    """A partitioned scan of a relational table (needs the driver jar on the class path)."""
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high, numPartitions=parts)


def read_window(df: DataFrame, ts: str, start, end=None) -> DataFrame:
    """Rows with ``start <= ts`` and, when given, ``ts < end``."""
    inside = F.col(ts) >= F.lit(start)
    if end is not None:
        inside = inside & (F.col(ts) < F.lit(end))
    return df.where(inside)


def _transaction_columns() -> list[Column]:
    uid = F.concat(F.lit("user_"), F.col("user_id").cast("string"))
    event = F.col("event_id")
    countries = F.array(*[F.lit(c) for c in HOME_COUNTRIES])
    hi = F.array_position(countries, home_country(uid)).cast("int") - 1
    shift = F.when(event % 20 == 0, 1).otherwise(0)
    category = (
        F.when(F.col("event_type") == "click", "electronics")
        .when(F.col("event_type") == "purchase", "crypto")
        .when(F.col("event_type") == "view", "groceries")
        .when(F.col("event_type") == "signup", "travel")
        .otherwise("gaming")
    )
    channel = (
        F.when(event % 4 == 0, "card_present")
        .when(event % 4 == 1, "card_not_present")
        .when(event % 4 == 2, "upi")
        .otherwise("login")
    )
    shared = F.concat(F.lit("dev_s"), (event % 2000).cast("string"))
    return [
        event,
        F.concat(F.lit("txn_"), event.cast("string")).alias("txn_id"),
        uid.alias("user_id"),
        (F.col("value") * 5).alias("amount"),
        F.lit("INR").alias("currency"),
        F.concat(F.lit("merchant_"), F.regexp_extract("props", "([0-9]+)", 1)).alias("merchant_id"),
        category.alias("merchant_category"),
        F.col("ts").alias("txn_timestamp"),
        F.when(event % 50 == 0, shared).otherwise(F.concat(F.lit("dev_"), uid)).alias("device_id"),
        F.element_at(countries, (hi + shift) % len(HOME_COUNTRIES) + 1).alias("ip_country"),
        channel.alias("channel"),
    ]


def as_transactions(events: DataFrame, keep_event_id: bool = False) -> DataFrame:
    """Events, a table or a stream, in the form of transactions."""
    df = events.withColumn("ts", F.col("ts").cast("timestamp")).select(*_transaction_columns())
    return df if keep_event_id else df.drop("event_id")


def transactions(spark: SparkSession, folder: str, keep_event_id: bool = False) -> DataFrame:
    return as_transactions(read_table(spark, folder, "events"), keep_event_id)


def _label_columns() -> list[Column]:
    score = rule_score("amount", "ip_country", "user_id", "channel", "merchant_category")
    event = F.col("event_id")
    draw = (event * 7919 % 10000) / F.lit(10000.0)
    return [
        F.col("txn_id"),
        (draw < score).alias("is_fraud"),
        F.lit("simulated_chargeback").alias("label_source"),
        (F.col("txn_timestamp") + F.expr("INTERVAL 2 HOURS")).alias("confirmed_at"),
        F.round(1 + (event % 71) / F.lit(10.0), 3).alias("delay_hours"),
    ]


def labels(spark: SparkSession, folder: str) -> DataFrame:
    return transactions(spark, folder, True).where("event_id % 3 <> 0").select(*_label_columns())


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """One prediction per transaction, by two model versions in turn."""
    event = F.col("event_id")
    return transactions(spark, folder, True).select(
        "txn_id",
        (F.col("amount") / (F.col("amount") + F.lit(300.0))).alias("fraud_probability"),
        (F.col("amount") / (F.col("amount") + F.lit(300.0)) >= 0.5).alias("is_flagged"),
        F.when(event % 2 == 0, "7").otherwise("8").alias("model_version"),
        (1 + (event * 37 % 2000) / F.lit(10.0)).alias("latency_ms"),
        F.when(event % 5 != 0, (event * 13 % 50) / F.lit(10.0)).alias("inference_latency_ms"),
        (F.col("txn_timestamp") + F.expr("INTERVAL 1 SECOND")).alias("scored_at"),
    )


def model_registry(spark: SparkSession, folder: str) -> DataFrame:
    """One model version per day of data, with measures taken over that day's labeled predictions.

    Every seventh version has no ``auc``, every fifth no ``best_threshold``; the
    first four versions are inactive.
    """
    scored = predictions(spark, folder).join(labels(spark, folder), "txn_id")
    day = F.day("scored_at")
    hit = F.when(F.col("is_flagged") == F.col("is_fraud"), 1.0).otherwise(0.0)
    both = F.when(F.col("is_flagged") & F.col("is_fraud"), 1.0).otherwise(0.0)
    daily = scored.groupBy(day.cast("int").alias("version")).agg(
        F.min("scored_at").alias("created_at"),
        F.round(F.avg(hit), 4).alias("auc"),
        F.round(F.avg(both), 4).alias("pr_auc"),
    )
    version = F.col("version")
    metrics = F.map_filter(
        F.create_map(
            F.lit("auc"), F.when(version % 7 != 0, F.col("auc")),
            F.lit("pr_auc"), F.col("pr_auc"),
            F.lit("best_threshold"), F.when(version % 5 != 0, F.round(0.3 + version / 100, 2)),
        ),
        lambda _, v: v.isNotNull(),
    )
    return daily.select(
        F.lit(MODEL_NAME).alias("model_name"),
        version.cast("string").alias("model_version"),
        F.concat(F.lit(f"models:/{MODEL_NAME}/"), version.cast("string")).alias("model_uri"),
        metrics.alias("metrics"),
        (version > 4).alias("is_active"),
        "created_at",
    )


def drift_events(spark: SparkSession, folder: str) -> DataFrame:
    """One drift check per six hours of data, measured on the mean prediction of the window."""
    probability = F.col("fraud_probability")
    slot = F.floor(F.unix_micros("scored_at") / F.lit(6 * 3600 * 1_000_000)).cast("bigint")
    checks = predictions(spark, folder).groupBy(slot.alias("slot")).agg(
        F.round(F.max(probability) - F.avg(probability), 4).alias("max_feature_psi"),
        F.round(F.avg(probability), 4).alias("mean_feature_psi"),
        F.max("model_version").alias("model_version"),
    )
    drifted = F.col("max_feature_psi") >= 0.45
    return checks.select(
        F.timestamp_micros((F.col("slot") + 1) * F.lit(6 * 3600 * 1_000_000)).alias("checked_at"),
        "model_version",
        "max_feature_psi",
        "mean_feature_psi",
        drifted.alias("drift_detected"),
        (drifted & (F.col("slot") % 2 == 0)).alias("retrain_triggered"),
        F.when(drifted & (F.col("slot") % 2 != 0), "cooldown").alias("retrain_skipped_reason"),
    )


def raw_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """JSON wire messages built from the events, with one known defect in part of them."""
    return as_payloads(transactions(spark, folder, True))


def as_payloads(t: DataFrame) -> DataFrame:
    """Wire messages of transactions with their ``event_id``, a table or a stream."""
    defect = F.col("event_id") % 40

    def text(name: str) -> Column:
        return F.concat(F.lit(f'"{name}":"'), F.col(name), F.lit('"'))

    stamp = F.concat(
        F.lit('"timestamp":"'),
        F.date_format("txn_timestamp", "yyyy-MM-dd'T'HH:mm:ss"),
        F.lit('Z"'),
    )
    parts = [
        text("txn_id"),
        F.when(defect == 1, None).otherwise(text("user_id")),
        F.when(defect == 2, F.lit('"amount":"NOT_A_NUMBER"'))
        .when(defect == 3, F.lit('"amount":-100.5'))
        .when(defect == 4, None)
        .when(defect == 15, F.lit('"amount":"12.5"'))
        .otherwise(F.concat(F.lit('"amount":'), F.round(F.col("amount") * 100).cast("bigint").cast("string"))),
        F.when(defect == 5, F.lit('"currency":12345')).otherwise(F.lit('"currency":"inr"')),
        F.when(defect == 6, F.lit('"merchant_id":{"id":"m6"}')).otherwise(text("merchant_id")),
        F.when(defect == 7, None).otherwise(text("merchant_category")),
        F.when(defect == 8, F.lit('"timestamp":"yesterday"'))
        .when(defect == 9, None)
        .when(defect == 16, F.lit('"timestamp":"2023-13-45T00:00:00Z"'))
        .otherwise(stamp),
        F.when(defect == 10, F.lit('"device_id":["d10"]')).otherwise(text("device_id")),
        F.when(defect == 11, F.lit('"ip_country":404')).otherwise(text("ip_country")),
        F.when(defect == 12, F.lit('"channel":"telepathy"'))
        .when(defect == 13, None)
        .otherwise(text("channel")),
    ]
    body = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    payload = F.when(defect == 14, F.lit("{}")).otherwise(body)
    # The inner object may itself travel as a JSON string.
    quoted = F.concat(F.lit('"'), F.replace(payload, F.lit('"'), F.lit('\\"')), F.lit('"'))
    data = F.when(defect == 17, quoted).otherwise(payload)
    value = (
        F.when(defect == 18, F.concat(F.lit('{"data":'), payload))
        .when(defect == 19, F.concat(F.lit('{"payload":'), payload, F.lit("}")))
        .otherwise(F.concat(F.lit('{"data":'), data, F.lit("}")))
    )
    return t.select(F.col("event_id").alias("offset"), value.alias("value"))
