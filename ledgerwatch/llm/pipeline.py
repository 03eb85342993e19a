"""Documents to packed sequences: each stage works on what the one before has kept, written as Parquet.

Defined results: nulls in any column, empty and very long texts, ties, repeated rows and clashing columns are handled by each
stage as its operator's module states; all stages but the last keep every column of their documents, extra ones included; an
empty table, or one of which a stage keeps nothing, gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerwatch.llm.common import documents
from ledgerwatch.llm.exact_dedup import drop_copies
from ledgerwatch.llm.mixing import mixed_documents
from ledgerwatch.llm.packing import pack
from ledgerwatch.llm.quality_rules import drop_bad
from ledgerwatch.llm.simhash import drop_near_copies
from ledgerwatch.session import persist_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return drop_bad(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id."""
    return drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("mixing", mixed),
    ("best_fit_packing", packed),
]

# Fingerprints and token ids have no SQL form; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = persist_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
