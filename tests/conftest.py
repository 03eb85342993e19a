import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerwatch.session import local_session  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    return local_session(8, **{"spark.checkpoint.dir": tmp_path_factory.mktemp("shared").as_uri()})


@pytest.fixture(scope="session")
def folder():
    return SF


BASE_US = 1_704_067_200_000_000  # 2024-01-01 00:00:00 UTC


@pytest.fixture(scope="session")
def make_txns(spark):
    """Transactions from short rows: (txn, user, seconds after the start, amount, merchant, country, device)."""
    from pyspark.sql import functions as F

    def build(rows):
        full = [(r + (10.0, "m1", "IN", "d_" + r[1])[len(r) - 3:]) if len(r) < 7 else r for r in rows]
        data = [(t, u, BASE_US + round(s * 1_000_000), float(a), m, c, d) for t, u, s, a, m, c, d in full]
        df = spark.createDataFrame(data, "txn_id string, user_id string, us long, amount double, merchant_id string, ip_country string, device_id string")
        return df.select(
            "txn_id", "user_id", "amount", F.lit("INR").alias("currency"), "merchant_id", F.lit("travel").alias("merchant_category"),
            F.timestamp_micros("us").alias("txn_timestamp"), "device_id", "ip_country", F.lit("upi").alias("channel"),
        )

    return build
