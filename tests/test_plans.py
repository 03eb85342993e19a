"""Plan properties that hold at any scale."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from ledgerwatch.operators import behaviour
from ledgerwatch.operators.ordering import percentiles

QUERIES = entry_module.queries()
# These run whole jobs of their own before returning; what they return is a plain scan.
EAGER = {"train_gbt", "score_batch", "stream_score", "stream_features", "src_stream"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_nested_loops(spark, folder, name):
    text = plan(QUERIES[name](spark, folder))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["txn_velocity", "amount_stats", "distinct_merchants", "seconds_since_last"])
def test_one_shuffle_per_user(spark, folder, name):
    text = plan(QUERIES[name](spark, folder))
    assert text.count("Exchange hashpartitioning") == 1 and "Python" not in text


def test_only_needed_columns_are_read(spark, folder):
    text = plan(QUERIES["txn_velocity"](spark, folder))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"event_id", "ts", "user_id"}


def test_window_scan_is_pushed_down(spark):
    from pyspark.sql import functions as F

    from ledgerwatch.sources import tables

    events = tables.read_table(spark, "/root/testdata/sf0.001", "events")
    cut = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    text = plan(tables.read_window(events, "ts", cut).select("event_id"))
    assert "GreaterThanOrEqual(ts" in text


def test_rank_filters_run_before_the_shuffle(spark, folder):
    text = plan(QUERIES["dedup_latest"](spark, folder))
    assert text.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("name", ["latency_timeseries", "stats_overview", "latency_summary", "latency_percentiles", "average_precision", "auc"])
def test_ranks_take_three_scans(spark, folder, name):
    """Of the events; what is joined to them for a metric is read as often."""
    text = plan(QUERIES[name](spark, folder))
    scans = text.count("FileScan parquet")
    assert scans <= (6 if name in ("auc", "average_precision") else 3)


def test_integrity_report_reads_each_table_once(spark, folder):
    assert plan(QUERIES["integrity_report"](spark, folder)).count("FileScan parquet") == 3


def test_ranks_shuffle_only_counts(spark):
    """A value that most rows have would take all of them to one task, or sort them there."""
    rows = spark.range(1000).select((F.col("id") % 3).cast("string").alias("g"), F.when(F.col("id") % 2 == 0, F.rand(1)).otherwise(0.0).alias("v"))
    text = plan(percentiles(rows, "v", {"p10": 0.1, "p50": 0.5}, ["g"]))
    assert text.count("BroadcastHashJoin") == 2
    assert "SortAggregate" not in text and "SortMergeJoin" not in text


def test_ordinary_users_are_placed_by_their_number_of_rows(spark, make_txns, monkeypatch):
    txns = make_txns([(f"t{i:03d}", f"u{i % 40}", 60 * i, i % 7) for i in range(200)])
    columns = ["txn_id", "txn_velocity_24h", "amount_std_24h", "distinct_merchants_1h", "seconds_since_last_txn"]
    before = behaviour.behaviour(txns).select(columns).orderBy("txn_id").collect()
    monkeypatch.setattr(behaviour, "TASK_ROWS", 10)
    rows = behaviour.behaviour(txns).select(columns)
    assert re.search(r"hashpartitioning\(_user#\d+, 20\), REPARTITION_BY_NUM", plan(rows))
    assert rows.orderBy("txn_id").collect() == before


def test_queries_compile_no_method_that_stays_interpreted(spark, folder):
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    QUERIES["txn_velocity"](spark, folder)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
