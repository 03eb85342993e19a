"""Labels as a stream: a transaction waits in its user's state until its outcome is known, and leaves as a label then."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ledgerwatch.functions.signals import hash_uniform, micros, rounded, rule_score
from ledgerwatch.operators.labels import assigned_delay
from ledgerwatch.schema import LABEL_DELAY_HOURS

# Executors get the processor with the job, so they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WATERMARK = "30 seconds"

_DUE = T.StructType([T.StructField("due_ms", T.LongType())])
_WAITING = T.StructType([T.StructField("rows", T.StringType())])
_EMITTED = T.StructType([T.StructField("due_ms", T.LongType()), T.StructField("carried", T.StringType())])
_CARRIED = "txn_id string, amount double, ip_country string, user_id string, channel string, merchant_category string, delay_hours double"


class Maturity(StatefulProcessor):
    """One timer and one entry per instant at which transactions of the user mature: each is touched when it is due."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", _DUE, _WAITING)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        arrived = {}
        for row in rows:
            if row.due_ms is not None:
                arrived.setdefault(row.due_ms, []).append(row.carried)
        for due_ms, carried in arrived.items():
            due = (due_ms,)
            held = json.loads(self.waiting.getValue(due)[0]) if self.waiting.containsKey(due) else []
            self.waiting.updateValue(due, (json.dumps([*held, *carried]),))
            if not held:
                self.handle.registerTimer(due_ms)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due = (expiredTimerInfo.getExpiryTimeInMs(),)
        # A timer has an entry: both come and go together.
        for carried in json.loads(self.waiting.getValue(due)[0]):
            yield Row(due_ms=due[0], carried=carried)
        self.waiting.removeKey(due)

    def close(self) -> None:
        pass


def stream_labels(
    txns: DataFrame,
    labels: DataFrame,
    ticks: DataFrame | None = None,
    bounds: tuple[float, float] = LABEL_DELAY_HOURS,
    watermark: str = WATERMARK,
    source: str = "simulated_chargeback",
) -> DataFrame:
    """Labels of the streamed transactions that ``labels``, a table, has none for, as the label pass would give them.

    A label is confirmed when the watermark has passed the transaction's delay, at the millisecond at which it was due.
    Needs the RocksDB state store.
    """
    waiting = txns.join(labels.select("txn_id"), "txn_id", "left_anti").withColumn("delay_hours", assigned_delay(*bounds))
    due = F.ceil((micros("txn_timestamp") + F.col("delay_hours") * F.lit(3.6e9)) / 1000).cast("bigint")
    carried = F.to_json(F.struct("txn_id", "amount", "ip_country", "user_id", "channel", "merchant_category", "delay_hours"))
    rows = waiting.select("user_id", "txn_timestamp", due.alias("due_ms"), carried.alias("carried"))
    if ticks is not None:
        rows = rows.unionByName(ticks.select(F.lit("").alias("user_id"), "txn_timestamp"), allowMissingColumns=True)
    found = rows.withWatermark("txn_timestamp", watermark).groupBy("user_id").transformWithState(
        statefulProcessor=Maturity(), outputStructType=_EMITTED, outputMode="append", timeMode="EventTime"
    )
    found = found.select("due_ms", F.from_json("carried", _CARRIED).alias("t")).select("due_ms", "t.*")
    score = rule_score("amount", "ip_country", "user_id", "channel", "merchant_category")
    return found.select(
        "txn_id",
        (hash_uniform("txn_id", "outcome") < score).alias("is_fraud"),
        F.lit(source).alias("label_source"),
        F.timestamp_millis("due_ms").alias("confirmed_at"),
        rounded(F.col("delay_hours"), 3).alias("delay_hours"),
    )
