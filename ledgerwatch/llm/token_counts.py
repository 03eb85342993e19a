"""Token counts of whole texts, by rank-synchronous merging of ragged arrays (``bpe``). Nothing is shuffled.

Defined results: a null text counts as empty (0 bytes, 0 tokens); an empty table gives no rows; repeated rows are
counted each; a text of any length is counted whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerwatch.llm.bpe import merger
from ledgerwatch.llm.common import bounded_batches, text_of

LIMIT = 1024


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit."""
    bounded_batches(docs.sparkSession)
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(merger(vocabulary).count(texts), pa.int64()),
                ],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    counted = plain.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
