"""Streams give what the batch operators give, also out of order, late and replayed."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerwatch.operators.behaviour import behaviour
from ledgerwatch.operators.joins import interval_join
from ledgerwatch.plans.reports import user_windows
from ledgerwatch.schema import TXN_SCHEMA
from ledgerwatch.streaming import pipeline
from ledgerwatch.streaming.features import OUTPUT, stream_features

END = 10 * 86400  # a far later transaction moves the watermark past all others


def write_files(df, path, files):
    """One file per list of transaction ids, in this order."""
    for i, ids in enumerate(files):
        df.where(F.col("txn_id").isin(ids)).coalesce(1).write.mode("append").json(str(path))
        import time

        time.sleep(0.02 if i < len(files) - 1 else 0)


def source(spark, path):
    return pipeline.read_stream(spark, "json", TXN_SCHEMA, path=str(path), maxFilesPerTrigger="1")


@pytest.fixture()
def rows(make_txns):
    data = [(f"t{i:02d}", f"u{i % 3}", i * 1500 + (i % 4) * 7, 5.0 + i % 5, f"m{i % 4}", "IN" if i % 5 else "US", "d") for i in range(40)]
    return make_txns(data + [("end", "zz", END, 1.0, "m", "IN", "d")])


def run(spark, path, tmp_path, name="out"):
    pipeline.use_rocksdb(spark)
    return pipeline.run_to_table(stream_features(source(spark, path)), str(tmp_path / name), str(tmp_path / "cp"))


def expected(rows):
    names = OUTPUT.names
    return {tuple(r) for r in behaviour(rows).where("txn_id <> 'end'").select(*names).collect()}


def test_stream_equals_batch_when_swapped_and_restarted(spark, rows, tmp_path):
    ids = [f"t{i:02d}" for i in range(40)]
    ids[10], ids[11] = ids[11], ids[10]
    files = [ids[:11], ids[11:25], ids[25:], ["end"]]
    # Order within 30 seconds of the watermark is restored: shift the swapped row close to its neighbour.
    near = F.when(F.col("txn_id") == "t11", F.timestamp_micros(F.unix_micros("txn_timestamp") - 1_490_000_000)).otherwise(F.col("txn_timestamp"))
    rows = rows.withColumn("txn_timestamp", near)
    write_files(rows, tmp_path / "in", files)
    got = {tuple(r) for r in run(spark, tmp_path / "in", tmp_path).where("txn_id <> 'end'").collect()}
    assert got == expected(rows)
    again = run(spark, tmp_path / "in", tmp_path)
    assert again.where("txn_id <> 'end'").count() == 40


def test_late_row_is_dropped(spark, rows, tmp_path):
    write_files(rows, tmp_path / "in", [[f"t{i:02d}" for i in range(40) if i != 5], ["t05"], ["end"]])
    got = run(spark, tmp_path / "in", tmp_path)
    assert "t05" not in {r.txn_id for r in got.collect()}
    assert got.where("txn_id <> 'end'").count() == 39


def test_ingest_is_idempotent(spark, tmp_path):
    good = {
        "txn_id": "x", "user_id": "u", "amount": 1.0, "currency": "inr", "merchant_id": "m", "merchant_category": "c",
        "timestamp": "2024-01-01T00:00:00Z", "device_id": "d", "ip_country": "IN", "channel": "upi",
    }
    texts = [json.dumps({"data": good}), json.dumps({"data": {**good, "channel": "?"}}), "{", json.dumps({"data": good})]
    folder = tmp_path / "in"
    spark.createDataFrame(list(enumerate(texts)), "offset long, value string").write.parquet(str(folder))
    for attempt in range(2):  # the second run has lost its checkpoint and sees everything again
        stream = pipeline.read_stream(spark, "parquet", spark.read.parquet(str(folder)).schema, path=str(folder))
        pipeline.ingest(stream, str(tmp_path / "ok"), str(tmp_path / "dlq"), str(tmp_path / f"cp{attempt}"))
    assert spark.read.parquet(str(tmp_path / "ok")).count() == 1
    reasons = [r.reason for r in pipeline.quarantined(spark, str(tmp_path / "dlq")).collect()]
    assert sorted(reasons) == ["enum:channel", "undecodable"]


def test_dual_write(spark, rows, tmp_path):
    write_files(rows, tmp_path / "in", [[f"t{i:02d}" for i in range(20)], [f"t{i:02d}" for i in range(20, 40)]])
    offline, online = str(tmp_path / "off"), pipeline.newest_per_user(str(tmp_path / "on"), rows.schema, every=2)
    for attempt in range(2):
        pipeline.run_available(source(spark, tmp_path / "in"), str(tmp_path / f"cp{attempt}"), pipeline.dual_write(offline, online))
    assert spark.read.parquet(offline).count() == 40
    as_of = F.lit("2024-01-02 00:00:00").cast("timestamp")
    view = pipeline.online_view(spark, online, as_of)
    assert {(r.user_id, r.txn_id) for r in view.collect()} == {("u0", "t39"), ("u1", "t37"), ("u2", "t38")}


def test_interval_join_stream_equals_batch(spark, rows, tmp_path):
    labels = rows.select("txn_id", (F.col("amount") > 7).alias("is_fraud"), (F.col("txn_timestamp") + F.make_dt_interval(secs=F.col("amount") * 900)).alias("confirmed_at"))
    batch = interval_join(rows, labels, 1, 2).select("txn_id", "is_fraud")
    rows.write.parquet(str(tmp_path / "t"))
    labels.write.parquet(str(tmp_path / "l"))
    t = pipeline.read_stream(spark, "parquet", rows.schema, path=str(tmp_path / "t"))
    l = pipeline.read_stream(spark, "parquet", labels.schema, path=str(tmp_path / "l"))
    got = pipeline.run_to_table(interval_join(t, l, 1, 2, "30 seconds").select("txn_id", "is_fraud"), str(tmp_path / "o"), str(tmp_path / "c"))
    assert batch.count() > 0
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in batch.collect()}


def test_user_windows_stream_equals_batch(spark, rows, tmp_path):
    rows.write.parquet(str(tmp_path / "t"))
    stream = pipeline.read_stream(spark, "parquet", rows.schema, path=str(tmp_path / "t")).withWatermark("txn_timestamp", "30 seconds")
    got = pipeline.run_to_table(user_windows(stream, "24 hours", "1 hour"), str(tmp_path / "o"), str(tmp_path / "c"))
    batch = user_windows(rows.where("txn_id <> 'end'"), "24 hours", "1 hour")
    key = lambda r: (r.user_id, r.window_start, r.txns, round(r.amount_sum, 6))
    assert {key(r) for r in got.collect()} == {key(r) for r in batch.collect()}


def test_late_events(spark, monkeypatch):
    rows = spark.createDataFrame([("a", 1, 100), ("b", 2, 69), ("c", 2, 70), ("d", 3, 500), ("e", 4, 400)], "txn_id string, batch int, s long")
    rows = rows.withColumn("ts", F.timestamp_seconds("s"))
    for block in (65_536, 2, 1):  # whole, and with batches in blocks of their own
        monkeypatch.setattr(pipeline, "BLOCK", block)
        assert {r.txn_id for r in pipeline.late_events(rows, "batch", "ts", 30).collect()} == {"b", "e"}


def test_same_instant_in_stream(spark, make_txns, tmp_path):
    rows = make_txns([("a", "u", 0, 1.0, "m", "IN", "d"), ("b", "u", 0, 2.0, "n", "IN", "d"), ("c", "u", 9, 4.0, "m", "IN", "d"), ("end", "zz", END, 1.0, "m", "IN", "d")])
    write_files(rows, tmp_path / "in", [["c", "b"], ["a"], ["end"]])
    # "a" comes a batch later but within the watermark.
    got = {tuple(r) for r in run(spark, tmp_path / "in", tmp_path).where("txn_id <> 'end'").collect()}
    assert got == expected(rows)
