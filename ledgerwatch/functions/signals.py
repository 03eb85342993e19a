"""Column expressions over one transaction or one prediction row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerwatch.schema import (
    DEFAULT_THRESHOLD,
    FEATURE_COLUMNS,
    HIGH_RISK_CATEGORIES,
    HOME_COUNTRIES,
    LABEL_RISK_CATEGORIES,
    SLA_MS,
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts: Column | str) -> Column:
    return F.unix_micros(_col(ts).cast("timestamp"))


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double, null where ``whole`` is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def rounded(c: Column, places: int) -> Column:
    """Half-up rounding that treats a value within 1e-12, or a few units in its last place, of a tie as the tie.

    What lifts a value to a tie never reaches a thousandth of the last place asked for, and values so
    large that they have no such places stay as they are. Plain double arithmetic: the built-in ``round`` goes through decimal text for
    every value, which would dominate the cost of a feature row.
    """
    scale = F.lit(float(10**places))
    scaled = F.abs(c) * scale
    nudge = F.least(scaled * F.lit(1e-15) + F.lit(10.0 ** (places - 12)), F.lit(1e-3))
    near = F.signum(c) * F.floor(scaled + nudge + F.lit(0.5)) / scale + F.lit(0.0)
    return F.when(scaled < F.lit(2.0**51), near).otherwise(c)


def hash_uniform(key: Column | str, salt: str = "") -> Column:
    """A reproducible uniform number in [0, 1) from the first 52 md5 bits of the key."""
    digest = F.md5(F.concat(_col(key), F.lit(salt)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def home_country(user_id: Column | str) -> Column:
    """The user's home country: sha-256 of the id modulo the country list.

    The list has eight entries, so the last hex digit decides.
    """
    digit = F.conv(F.right(F.sha2(_col(user_id), 256), F.lit(1)), 16, 10).cast("int")
    countries = F.array(*[F.lit(c) for c in HOME_COUNTRIES])
    return F.element_at(countries, digit % len(HOME_COUNTRIES) + 1)


def _flag(condition: Column) -> Column:
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def is_foreign_ip(ip_country: Column | str, user_id: Column | str) -> Column:
    return _flag(_col(ip_country) != home_country(user_id))


def log_amount(amount: Column | str) -> Column:
    return rounded(F.log1p(_col(amount)), 6)


def is_card_not_present(channel: Column | str) -> Column:
    return _flag(_col(channel) == "card_not_present")


def is_high_risk_category(category: Column | str) -> Column:
    return _flag(_col(category).isin(HIGH_RISK_CATEGORIES))


def zscore(amount: Column, mean: Column, std: Column) -> Column:
    """Deviation from the user's history; 0 where the spread is 0 or the score is not finite."""
    z = F.try_divide(amount - mean, std)
    usable = (std > 0) & ~F.isnan(z) & (F.abs(z) != F.lit(float("inf")))
    return F.coalesce(rounded(F.when(usable, z), 6), F.lit(0.0))


def with_direct_signals(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "is_foreign_ip": is_foreign_ip("ip_country", "user_id"),
            "log_amount": log_amount("amount"),
            "is_card_not_present": is_card_not_present("channel"),
            "is_high_risk_category": is_high_risk_category("merchant_category"),
        }
    )


def rule_score(
    amount: Column | str,
    ip_country: Column | str,
    user_id: Column | str,
    channel: Column | str,
    category: Column | str,
) -> Column:
    """Probability that a transaction turns out fraudulent under the label rule."""
    country = _col(ip_country)
    suspicious = (_col(amount) > 1000) | ((country != "") & (country != home_country(user_id)))
    base = F.when(F.coalesce(suspicious, F.lit(False)), F.lit(0.95)).otherwise(F.lit(0.01))
    card = F.when(_col(channel) == "card_not_present", F.lit(0.05)).otherwise(F.lit(0.0))
    goods = F.when(_col(category).isin(LABEL_RISK_CATEGORIES), F.lit(0.05)).otherwise(F.lit(0.0))
    return F.least(base + card + goods, F.lit(0.98))


def sla_met(latency_ms: Column | str, limit: float = SLA_MS) -> Column:
    return _col(latency_ms) < limit


def inference_ms() -> Column:
    """Model time where recorded, otherwise the whole request time."""
    return F.coalesce(F.col("inference_latency_ms"), F.col("latency_ms"))


def flag_at(probability: Column | str, threshold: Column | float = DEFAULT_THRESHOLD) -> Column:
    return _col(probability) >= threshold


def vector_columns(df: DataFrame, key: str = "snapshot_key", features: list[str] = FEATURE_COLUMNS) -> DataFrame:
    """Fill the model vector: a missing or unreadable feature becomes 0.0.

    ``key`` is null where no snapshot was found; such rows are cold starts.
    """
    filled = {c: F.coalesce(F.expr(f"try_cast(`{c}` AS double)"), F.lit(0.0)) for c in features}
    return df.withColumns({**filled, "is_cold_start": F.col(key).isNull()})


def register_sql_functions(spark: SparkSession) -> None:
    """Expose the two rules that analysts use in SQL text."""
    countries = ",".join(f"'{c}'" for c in HOME_COUNTRIES)
    goods = ",".join(f"'{c}'" for c in LABEL_RISK_CATEGORIES)
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION home_country(user_id STRING) RETURNS STRING
        RETURN element_at(array({countries}),
                          CAST(conv(right(sha2(user_id, 256), 1), 16, 10) AS INT) % {len(HOME_COUNTRIES)} + 1)"""
    )
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION rule_score(
            amount DOUBLE, ip_country STRING, user_id STRING, channel STRING, category STRING) RETURNS DOUBLE
        RETURN least(
            CASE WHEN amount > 1000 OR (ip_country <> '' AND ip_country <> home_country(user_id))
                 THEN 0.95D ELSE 0.01D END
            + CASE WHEN channel = 'card_not_present' THEN 0.05D ELSE 0D END
            + CASE WHEN category IN ({goods}) THEN 0.05D ELSE 0D END, 0.98D)"""
    )
