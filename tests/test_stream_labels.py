"""Labels from the stream are those of the batch pass at the same instant."""

from pyspark.sql import Row, functions as F

from ledgerwatch.operators.labels import assigned_delay, label_pass
from ledgerwatch.schema import TXN_SCHEMA
from ledgerwatch.streaming import pipeline
from ledgerwatch.streaming.labels import Maturity, stream_labels
from tests.conftest import BASE_US


def test_stream_equals_pass(spark, make_txns, tmp_path):
    rows = make_txns([(f"t{k:02d}", f"u{k % 4}", k * 3600, 900.0 + 10 * k, "m", "IN", "d") for k in range(60)])
    known = rows.where("txn_id in ('t03', 't07')").select("txn_id", F.lit(True).alias("is_fraud"))
    for part in range(3):
        rows.where(F.expr(f"cast(substr(txn_id, 2) as int) div 20 = {part}")).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    source = pipeline.read_stream(spark, "json", TXN_SCHEMA, path=str(tmp_path / "in"), maxFilesPerTrigger="1")
    at_ms = BASE_US // 1000 + 62 * 3_600_000
    pipeline.use_rocksdb(spark)

    def start(ticks):
        return pipeline.start_to_table(stream_labels(source, known, ticks), str(tmp_path / "out"), str(tmp_path / "cp"))

    pipeline.run_and_close(spark, start, str(tmp_path), "30 seconds", at_ms)
    got = spark.read.parquet(str(tmp_path / "out"))
    expected = label_pass(rows, known, F.timestamp_millis(F.lit(at_ms)), batch=None)
    names = ["txn_id", "is_fraud", "label_source", "delay_hours"]
    pairs = {tuple(r) for r in got.select(*names).collect()}
    assert 20 < len(pairs) < 58 and pairs == {tuple(r) for r in expected.select(*names).collect()}
    # Each was confirmed in the millisecond in which it was due.
    lag = (F.unix_micros("confirmed_at") - F.unix_micros("txn_timestamp")) / 3.6e9 - assigned_delay()
    off = got.select("txn_id", "confirmed_at").join(rows, "txn_id").select((lag * 3.6e6).alias("ms")).collect()
    assert all(-0.01 <= r.ms <= 1.01 for r in off)


class _Calls:
    """A stand-in for a user's state that notes what is asked of it."""

    def __init__(self):
        self.kept, self.timers, self.calls = {}, [], []

    def getMapState(self, *_):
        return self

    def registerTimer(self, at):
        self.calls.append("timer")
        self.timers.append(at)

    def containsKey(self, key):
        self.calls.append("contains")
        return key in self.kept

    def getValue(self, key):
        self.calls.append("get")
        return self.kept[key]

    def updateValue(self, key, value):
        self.calls.append("update")
        self.kept[key] = value

    def removeKey(self, key):
        self.calls.append("remove")
        del self.kept[key]

    def getExpiryTimeInMs(self):
        return self.timers[0]


def test_rows_due_together_touch_the_state_once():
    state, user = _Calls(), Maturity()
    user.init(state)
    rows = [Row(due_ms=7, carried=f"r{k}") for k in range(5)] + [Row(due_ms=None, carried=None)]
    assert list(user.handleInputRows(("u",), iter(rows), None)) == []
    assert state.calls == ["contains", "update", "timer"] and state.timers == [7]
    list(user.handleInputRows(("u",), iter([Row(due_ms=7, carried="late")]), None))
    assert state.calls[3:] == ["contains", "get", "update"]
    state.calls.clear()
    out = [r.carried for r in user.handleExpiredTimer(("u",), None, state)]
    assert out == ["r0", "r1", "r2", "r3", "r4", "late"] and state.calls == ["get", "remove"] and not state.kept
