"""Rare and moderate words count at every number of labels; long texts are judged like short ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwatch.llm import quality_classifier
from ledgerwatch.llm.common import documents


def test_rare_words_have_weights():
    n = np.array([25_000, 25_000])
    counts = np.array([[0, 1000, 1, 5000], [62, 5000, 0, 5000]])
    rare, moderate, once, even = quality_classifier.word_weights(counts, n)
    assert rare > 3 and 1.5 < moderate < 1.7 and abs(once) < 1 and abs(even) < 0.1


@pytest.mark.parametrize("labelled", [200, 1500])
def test_words_5_to_30_times_as_frequent(docs_of, spark, labelled):
    rng = random.Random(labelled)
    usual = [f"usual{k}" for k in range(3000)]
    telling = [(f"telling{k}", 5 + 25 * k / 59) for k in range(60)]
    rows, labels = [], []
    for i in range(labelled + 600):
        toxic = rng.random() < 0.5
        words = rng.choices(usual, k=rng.choice([40, 150, 600]))
        words += [w for w, times in telling if rng.random() < 0.006 * (times if toxic else 1)]
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = quality_classifier.classify(docs_of(rows, extra=False), table.where(F.col("doc_id") < labelled)).collect()
    new = [(r.kept, len(rows[r.doc_id][1].split()) > 500, labels[r.doc_id][2]) for r in found if r.doc_id >= labelled]
    right = [kept != toxic for kept, _, toxic in new]
    long_clean = [kept for kept, long, toxic in new if long and not toxic]
    print(labelled, np.mean(right), np.mean(long_clean))
    assert np.mean(right) > 0.9 and np.mean(long_clean) > 0.85


def test_labels_of_the_smallest_table(spark, folder):
    small, large = folder.replace("sf0.1", "sf0.001"), folder.replace("sf0.001", "sf0.1")
    given = spark.read.parquet(f"{small}/labels.parquet").withColumn("doc_id", -1 - F.col("doc_id"))
    docs = documents(spark, small).withColumn("doc_id", -1 - F.col("doc_id")).unionByName(documents(spark, large))
    found = quality_classifier.classify(docs, given).join(spark.read.parquet(f"{large}/labels.parquet"), "doc_id").collect()
    right = np.mean([r.kept == (r.quality == 1 and r.toxic == 0) for r in found])
    bad = np.mean([r.kept for r in found if r.quality == 0])
    clean = np.mean([r.kept for r in found if r.quality == 1 and r.toxic == 0])
    print(given.count(), right, bad, clean)
    assert bad < 0.5 and clean > 0.9
