"""Idempotent writes expressed as relational operations on the target table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ledgerwatch.operators.joins import dedup_latest


def new_rows(target: DataFrame, rows: DataFrame, keys: list[str], first: list[Column] = ()) -> DataFrame:
    """Rows to append under "on conflict do nothing": one per key, keys of the target left out.

    ``first`` orders the copies within ``rows``; the first one wins.
    """
    single = dedup_latest(rows, keys, list(first)) if first else rows.dropDuplicates(keys)
    return single.join(target.select(*keys), keys, "left_anti").select(*rows.columns)


def insert_ignore(target: DataFrame, rows: DataFrame, keys: list[str], first: list[Column] = ()) -> DataFrame:
    """The target after the insert."""
    added = new_rows(target, rows, keys, first)
    return target.unionByName(added.select(*target.columns))


def upsert(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The target after "on conflict do update"; ``rows`` holds each key once."""
    kept = target.join(rows.select(*keys), keys, "left_anti").select(*target.columns)
    return kept.unionByName(rows.select(*target.columns))


def backfill(target: DataFrame, updates: DataFrame, key: str, columns: list[str], overwrite: bool = True) -> DataFrame:
    """Set ``columns`` on all target rows of an updated key; ``updates`` holds each key once."""
    given = updates.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = target.join(given, key, "left")

    def merged(c: str) -> Column:
        if c not in target.columns:
            return F.col(f"_new_{c}")
        order = [f"_new_{c}", c] if overwrite else [c, f"_new_{c}"]
        return F.coalesce(*order)

    names = target.columns + [c for c in columns if c not in target.columns]
    return joined.select(*[merged(c).alias(c) if c in columns else F.col(c) for c in names])


def log_predictions(transactions: DataFrame, predictions: DataFrame, scored: DataFrame, keep: list[str]):
    """Store the scored transactions that are missing, then append their predictions."""
    stored = insert_ignore(transactions, scored.select(*transactions.columns), ["txn_id"])
    return stored, predictions.unionByName(scored.select(*keep))


def append_new(
    path: str, rows: DataFrame, keys: list[str], day: str | Column, run: str = "none", batch: int = 0
) -> None:
    """Append to a Parquet folder what it does not hold yet; running it again adds nothing.

    ``day`` is a date that follows from the key, as a transaction's own time does; rows without one share a day. The table
    has a folder per day, run and batch. Stored keys are read of the days that ``rows`` touches and of no others, so a
    batch costs what these days hold, however long the history is. The folders of ``run`` and ``batch`` are overwritten
    and do not count as held: a batch that failed halfway and is repeated ends as if it had been written once.
    The days of one batch, a few by the delay of a stream, are listed on the driver.
    """
    spark = rows.sparkSession
    marked = rows.withColumns({"day": day if isinstance(day, Column) else F.col(day), "run": F.lit(run), "batch": F.lit(batch).cast("bigint")})
    marked = marked.withColumn("day", F.coalesce(F.date_format("day", "yyyy-MM-dd"), F.lit("none")))
    days = [r.day for r in marked.select("day").distinct().collect()]
    if not days:
        return
    marks = [T.StructField("day", T.StringType()), T.StructField("run", T.StringType()), T.StructField("batch", T.LongType())]
    folders = f"{path}/day={{{','.join(sorted(days))}}}"
    try:
        stored = spark.read.schema(T.StructType([*rows.schema.fields, *marks])).option("basePath", path).parquet(folders)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        fresh = marked.dropDuplicates(keys)
    else:
        held = stored.where(~((F.col("run") == run) & (F.col("batch") == batch)))
        fresh = new_rows(held, marked, keys)
    # Only the folders of this batch are replaced.
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "run", "batch").parquet(path)
