"""Session defaults and the shared folders a job may write to."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A long-lived session runs more different stages than the default 100 compiled classes.
    "spark.sql.codegen.cache.maxEntries": "2000",
}

# The JVM interprets methods of more than 8000 bytes of code; Spark splits up what it would have compiled to a longer one.
_METHOD_BYTES = "8000"


def local_session(cores: int | str = "*", app: str = "ledgerwatch", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    builder = builder.config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
    builder = builder.config("spark.sql.shuffle.partitions", "8")
    for key, value in {**_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def pin_session(spark: SparkSession) -> None:
    """All event-time arithmetic here is in UTC, and no wide stage is left to the JVM's interpreter."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", _METHOD_BYTES)


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    Only a local session without ``spark.checkpoint.dir``, as in tests, takes a temporary
    folder; on a cluster executors and driver would each see another one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="ledgerwatch-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def persist_table(df, label: str):
    """Cut lineage by writing ``df`` to the shared folder and reading it back."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_table(df):
    """Pin a table whose size does not grow with the data, such as one row per feature or model."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)
