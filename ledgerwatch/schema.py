"""Schemas and fixed values of the transaction-risk data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Feature contract, in vector order.
FEATURE_COLUMNS = [
    "txn_velocity_1h",
    "txn_velocity_24h",
    "amount_mean_24h",
    "amount_std_24h",
    "amount_zscore",
    "distinct_merchants_1h",
    "distinct_merchants_24h",
    "impossible_travel_flag",
    "seconds_since_last_txn",
    "shared_device_count",
    "shared_merchant_fraud_count",
    "hop_distance_to_fraud",
    "is_foreign_ip",
    "log_amount",
    "is_card_not_present",
    "is_high_risk_category",
]

# Those of them that are no whole numbers.
REAL_FEATURES = [
    "amount_mean_24h",
    "amount_std_24h",
    "amount_zscore",
    "seconds_since_last_txn",
    "is_foreign_ip",
    "log_amount",
    "is_card_not_present",
    "is_high_risk_category",
]

# Domains.
HOME_COUNTRIES = ["US", "GB", "IN", "DE", "BR", "NG", "SG", "AU"]
CHANNELS = ["card_present", "card_not_present", "upi", "login"]
HIGH_RISK_CATEGORIES = ["electronics", "gift_cards", "crypto", "jewelry", "gaming"]
LABEL_RISK_CATEGORIES = ["electronics", "gift_cards", "crypto"]
EDGE_TYPES = ["USED_DEVICE", "TRANSACTED_AT", "FROM_COUNTRY"]

# Thresholds and horizons.
US_PER_SECOND = 1_000_000
HOUR_US = 3600 * US_PER_SECOND
DAY_US = 24 * HOUR_US
HISTORY_TTL_SECONDS = 86_700
TRAVEL_MAX_SECONDS = 3600
ONLINE_TTL_HOURS = 48
SLA_MS = 100.0
DEFAULT_THRESHOLD = 0.5
MIN_LABELED_ROWS = 1000
LABEL_DELAY_HOURS = (1.0, 72.0)
LABEL_BATCH = 500
MIN_BANDIT_OBSERVATIONS = 30
PSI_BUCKETS = 10
PSI_FLOOR = 1e-6
PSI_WARN, PSI_DRIFT = 0.10, 0.25
KS_MIN_ROWS = 20
DRIFT_MIN_ROWS = 200
BASELINE_HOURS = 72
LIVE_HOURS = 6
RETRAIN_COOLDOWN_MINUTES = 60
KEEP_ACTIVE_MODELS = 3
SERVING_MODELS = 2
MODEL_NAME = "fraud-model"
# Amounts from here on are quarantined: the exact sums of squares hold ten thousand smaller ones per window.
MAX_AMOUNT = 1e11

TXN_FIELDS = [
    "txn_id",
    "user_id",
    "amount",
    "currency",
    "merchant_id",
    "merchant_category",
    "timestamp",
    "device_id",
    "ip_country",
    "channel",
]

# A decoded transaction; the wire name of txn_timestamp is "timestamp".
TXN_SCHEMA = T.StructType(
    [
        T.StructField("txn_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("currency", T.StringType()),
        T.StructField("merchant_id", T.StringType()),
        T.StructField("merchant_category", T.StringType()),
        T.StructField("txn_timestamp", T.TimestampType()),
        T.StructField("device_id", T.StringType()),
        T.StructField("ip_country", T.StringType()),
        T.StructField("channel", T.StringType()),
    ]
)
