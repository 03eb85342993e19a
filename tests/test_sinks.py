from pyspark.sql import functions as F

from ledgerwatch.operators import registry as rg
from ledgerwatch.schema import MODEL_NAME
from ledgerwatch.sources import sinks


def table(spark, rows, schema="k string, v int"):
    return spark.createDataFrame(rows, schema)


def as_dict(df):
    return {r.k: r.v for r in df.collect()}


def test_insert_ignore_keeps_stored_and_first(spark):
    target = table(spark, [("a", 1)])
    rows = table(spark, [("a", 2), ("b", 4), ("b", 3)])
    assert as_dict(sinks.insert_ignore(target, rows, ["k"], [F.asc("v")])) == {"a": 1, "b": 3}


def test_insert_ignore_twice_is_once(spark):
    rows = table(spark, [("a", 1), ("b", 2)])
    once = sinks.insert_ignore(rows.limit(0), rows, ["k"])
    assert sinks.insert_ignore(once, rows, ["k"]).count() == 2


def test_upsert_replaces(spark):
    assert as_dict(sinks.upsert(table(spark, [("a", 1), ("b", 2)]), table(spark, [("b", 9), ("c", 3)]), ["k"])) == {"a": 1, "b": 9, "c": 3}


def test_backfill_sets_all_rows_of_a_key(spark):
    target = table(spark, [("a", 1), ("a", 2), ("b", 3)])
    got = sinks.backfill(target, table(spark, [("a", 7)]), "k", ["v"]).collect()
    assert sorted((r.k, r.v) for r in got) == [("a", 7), ("a", 7), ("b", 3)]
    kept = sinks.backfill(target, table(spark, [("a", 7)]), "k", ["v"], overwrite=False).collect()
    assert sorted((r.k, r.v) for r in kept) == [("a", 1), ("a", 2), ("b", 3)]


def test_append_new_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    day = F.make_date(F.lit(2024), F.lit(1), F.ascii("k") - 96)
    for run in ("x", "y"):
        sinks.append_new(path, table(spark, [("a", 1), ("b", 2), ("b", 2)]), ["k"], day, run)
    sinks.append_new(path, table(spark, [("b", 5), ("c", 3)]), ["k"], day, "x", 1)
    sinks.append_new(path, table(spark, []), ["k"], day, "x", 2)
    got = spark.read.parquet(path)
    assert got.count() == 3 and as_dict(got) == {"a": 1, "b": 2, "c": 3}


def test_append_new_repeats_a_batch_that_failed_halfway(spark, tmp_path):
    path = str(tmp_path / "t")
    day = F.make_date(F.lit(2024), F.lit(1), F.col("v"))
    sinks.append_new(path, table(spark, [("a", 1)]), ["k"], day, "x", 0)
    for rows in ([("b", 1), ("c", None)], [("b", 1), ("c", None), ("d", 2), ("a", 1)]):
        sinks.append_new(path, table(spark, rows), ["k"], day, "x", 1)
    got = spark.read.parquet(path)
    assert got.count() == 4 and as_dict(got) == {"a": 1, "b": 1, "c": None, "d": 2}


def test_append_new_reads_only_the_days_of_the_batch(spark, tmp_path):
    path = str(tmp_path / "t")
    day = F.make_date(F.lit(2024), F.lit(1), F.col("v"))
    sinks.append_new(path, table(spark, [(f"k{i}", i) for i in range(1, 6)]), ["k"], day, "x", 0)
    # Other days are never opened: a file that is no Parquet would fail the append.
    for other in (1, 2, 4, 5):
        (tmp_path / "t" / f"day=2024-01-0{other}" / "run=x" / "batch=0" / "broken.parquet").write_text("no parquet")
    sinks.append_new(path, table(spark, [("k3", 3), ("k9", 3)]), ["k"], day, "x", 1)
    held = spark.read.option("basePath", path).parquet(f"{path}/day=2024-01-03")
    assert sorted(r.k for r in held.collect()) == ["k3", "k9"]


def models(spark, aucs, active=True):
    rows = [(MODEL_NAME, str(i), "uri", {"auc": a} if a is not None else {}, active, i) for i, a in enumerate(aucs)]
    df = spark.createDataFrame(rows, "model_name string, model_version string, model_uri string, metrics map<string,double>, is_active boolean, n int")
    return df.withColumn("created_at", F.timestamp_seconds("n")).drop("n")


def active(df):
    return sorted(r.model_version for r in df.where("is_active").collect())


def test_retire_keeps_the_best_three(spark):
    assert active(rg.retire_models(models(spark, [0.8, None, 0.9, 0.7, 0.85]))) == ["0", "2", "4"]


def test_register_leaves_at_most_four_active(spark):
    registry = models(spark, [0.8, None, 0.9, 0.7, 0.85])
    new = models(spark, [0.1]).withColumn("model_version", F.lit("new"))
    assert active(rg.register(registry, new)) == ["0", "2", "4", "new"]
    idle = new.withColumn("is_active", F.lit(False))
    assert active(rg.register(registry, idle)) == ["0", "1", "2", "3", "4"]


def test_serving_and_delta(spark):
    registry = models(spark, [0.8, None, 0.9])
    serving = rg.serving_models(registry)
    assert [(r.model_version, r.slot) for r in serving.orderBy("slot").collect()] == [("2", 0), ("0", 1)]
    assert rg.registry_delta(serving, serving).count() == 0
    delta = rg.registry_delta(registry.where("model_version in ('0', '1')"), serving)
    assert {(r.model_version, r.action) for r in delta.collect()} == {("2", "load"), ("1", "unload")}


def test_promotion(spark):
    registry = models(spark, [0.8]).withColumn("metrics", F.create_map(F.lit("pr_auc"), F.lit(0.5)))
    weaker = registry.withColumn("metrics", F.create_map(F.lit("pr_auc"), F.lit(0.4)))
    assert rg.promotion_decision(registry, weaker).first().promote
    assert not rg.promotion_decision(registry, weaker, force=False).first().promote
    assert not rg.promotion_decision(registry, weaker, artifact_ok=False).first().promote
    assert rg.promotion_decision(registry.limit(0), weaker, force=False).first().promote
