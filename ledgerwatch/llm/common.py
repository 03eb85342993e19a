"""What the corpus operators share: reading, text columns, batch bounds, lookups in sharded indexes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: One white-space character of the word rules, as a Java pattern.
SPACE = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def bounded_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Python workers get this many rows at a time, so that long texts stay within their memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def text_of(text: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def id_key(column: str) -> Column:
    """An id as text that is never null, so that rows can be joined and grouped by it with one exchange."""
    return F.coalesce(F.concat(F.lit("i"), F.col(column).cast("string")), F.lit("null"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that ``df`` has already."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+", -1), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """A-Z lowered and nothing else; the cheap built-in serves where every character is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def shard_of(digest: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(shards)).cast("int")


def shard_count(keys: int, keys_per_shard: int) -> int:
    return max(1, -(-keys // keys_per_shard))


def lookup(
    probes: DataFrame,
    index: DataFrame,
    spread: str | list[str],
    find: Callable,
    schema: str,
    rows_per_group: int = 100_000,
) -> DataFrame:
    """Brings each shard's probes to its index row and calls ``find(probes, index)`` on the two pandas frames.

    Both tables have a column ``shard``. A shard with many probes, as a hot key makes it, is cut by a hash of
    ``spread`` into groups of about ``rows_per_group`` rows, and its index row is sent to each of them.
    ``index`` may lack shards; ``find`` then gets an empty frame.
    """
    sizes = probes.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / rows_per_group).cast("int").alias("_cuts"))
    cut = probes.join(sizes, "shard").withColumn(
        "_cut", F.pmod(F.xxhash64(*([spread] if isinstance(spread, str) else spread), F.lit("cut")), F.col("_cuts")).cast("int")
    )
    copies = index.join(sizes, "shard").withColumn("_cut", F.explode(F.sequence(F.lit(0), F.col("_cuts") - 1)))
    keys = ["shard", "_cut"]
    left, right = cut.drop("_cuts").groupBy(*keys), copies.drop("_cuts").groupBy(*keys)
    return left.cogroup(right).applyInPandas(find, schema)
