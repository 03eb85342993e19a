"""Quality classifier with hierarchical empirical Bayes over sites.

Two questions are asked of a document, each answered by labels: is its text good, and is it toxic. The text is seen as
the set of its words, word endings and shapes, and how much it repeats itself. Each of them has a log likelihood ratio
with a beta prior, weighed by the probability that it differs between the labels at all, given its counts and the share
of those that do (by expectation maximisation). So a rare or moderate word adds its part and a chance finding next to
none, whatever the number of labels. What speaks against a text, what speaks for it and its length become its evidence by
a logistic fit of their logarithms; each labelled document is weighed there by what the other folds' labels say, so the fit
sees what the words are worth on new texts, and takes off what a long text gathers by chance.
The site adds what is known of its host and path: the rate of a host is the mean of a beta
distribution whose prior is the rate of all labels, that of a path has its host's rate as prior, and how much a prior
weighs follows from how much sites differ (method of moments). So a path without labels has its host's rate, and a host
without labels the rate of all. The logit of a document is its evidence plus that of its path's rate.

Sites are counted by grouped aggregation over all labels. The words are fitted on at most ``max_labelled`` labelled
documents, those with the smallest hashes of their ids; the weights are two arrays of 2^18 numbers and four numbers each.

Defined results: a null or empty text has no evidence and gets the rate of its path; null hosts and paths are sites of
their own; without labels both rates are one half; labels with a null id or value, or without a document, are not used;
repeated rows are classified each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerwatch.llm.common import bounded_batches, id_key, text_of
from ledgerwatch.session import persist_table

MAX_LABELLED = 50_000
BUCKETS = 1 << 18
#: The beta prior of a word's share between the labels weighs this many documents.
PRIOR = 1.0
#: Labelled documents are weighed by the words of the other folds. Copies of a text are in one fold.
FOLDS = 4
#: Precision of the normal prior of the standardised coefficients of the logistic fit.
RIDGE = 1.0
_ENDS = ".,;:!?\"'()[]{}#%&*$|<>-_=+/\\~`"
_REMEMBERED = 500_000


# -- words -------------------------------------------------------------------------------


def _places(word: str) -> tuple[int, ...]:
    """Buckets of the bare word, of the marks it ends with, and of its shape."""
    bare = word.strip(_ENDS)
    tail = word[len(word.rstrip(_ENDS)) :]
    names = ["w" + bare.lower(), "e" + tail]
    if len(bare) > 1 and bare.isupper():
        names.append("s" + tail + "upper")
    return tuple(zlib.crc32(n.encode()) % BUCKETS for n in names)


class _Words(dict):
    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > _REMEMBERED:
            self.clear()
        self[word] = found = _places(word)
        return found


def features(text: str, words: _Words) -> list[int]:
    """The distinct buckets of a whole text."""
    all_words = text.split()
    distinct = set(all_words)
    found = {b for w in distinct for b in words[w]}
    if len(all_words) >= 20:
        size = len(all_words).bit_length()
        again = sum(a == b for a, b in zip(all_words, all_words[1:]))
        for name in (f"d{size}:{10 * len(distinct) // len(all_words)}", f"a{20 * again // len(all_words)}"):
            found.add(zlib.crc32(name.encode()) % BUCKETS)
    return list(found)


def _log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    def log_gamma(x: np.ndarray) -> np.ndarray:
        distinct, at = np.unique(x, return_inverse=True)
        return np.array([lgamma(v) for v in distinct])[at].reshape(np.shape(x))

    return log_gamma(a) + log_gamma(b) - log_gamma(a + b)


def word_weights(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Expected log likelihood ratio of label 1 per bucket, from the documents of each label that hold it (2 rows) and all of each."""
    weights = np.zeros(counts.shape[1])
    held = np.nonzero(counts.sum(axis=0))[0]
    if not (n.all() and len(held)):
        return weights
    k0, k1 = counts[:, held].astype(float)
    a0, a1 = PRIOR * n / n.sum()
    # How much likelier the counts are with a share of the word's own than with that of the labels.
    gain = _log_beta(k1 + a1, k0 + a0) - _log_beta(np.array([a1]), np.array([a0])) - k1 * np.log(n[1] / n.sum()) - k0 * np.log(n[0] / n.sum())
    share = 0.01
    for _ in range(30):
        differs = _logistic(np.log(share / (1 - share)) + gain)
        share = np.clip(differs.mean(), 1e-6, 0.5)
    weights[held] = differs * (np.log((k1 + a1) / (k0 + a0)) - np.log(a1 / a0))
    return weights


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def _terms(against: np.ndarray, for_it: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(size)), np.log1p(against), np.log1p(for_it), np.log(np.maximum(size, 1))], axis=1)


def calibrate(terms: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Coefficients of the logit of ``bad``; what speaks against a text never lowers it, what speaks for it never raises it."""
    mean, spread = terms.mean(axis=0), terms.std(axis=0) + 1e-9
    mean[0], spread[0] = 0, 1
    z, found = (terms - mean) / spread, np.zeros(terms.shape[1])
    ridge = np.array([1e-6] + [RIDGE] * (len(found) - 1))
    for _ in range(100):
        p = _logistic(z @ found)
        curve = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(ridge)
        new = found + np.clip(np.linalg.solve(curve, z.T @ (bad - p) - ridge * found), -2, 2)
        new[1], new[2] = max(new[1], 0), min(new[2], 0)
        found, moved = new, np.abs(new - found).max()
        if moved < 1e-8:
            break
    found = found / spread
    found[0] -= found[1:] @ mean[1:]
    return found


@dataclass(frozen=True)
class Head:
    """Word weights, positive for what speaks against a text, and the coefficients of the evidence; ``sign`` is that of bad texts' logit."""

    weights: np.ndarray
    coefficients: np.ndarray
    sign: int

    def evidence(self, against: np.ndarray, for_it: np.ndarray, size: np.ndarray) -> np.ndarray:
        return np.where(size > 0, self.sign * (_terms(against, for_it, size) @ self.coefficients), 0.0)


def label_features(known: DataFrame, labels: tuple[str, ...], text: str = "text") -> DataFrame:
    """(fold, places, labels) of the labelled texts."""
    body = text_of(text)
    rows = known.select(F.pmod(F.xxhash64(body), F.lit(FOLDS)).alias("fold"), body.alias("text"), *[F.col(c).cast("long").alias(c) for c in labels])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            places = pa.array([features(value.as_py(), words) for value in batch.column("text")], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("fold"), places, *[batch.column(c) for c in labels]], names=["fold", "places", *labels])

    return rows.mapInArrow(emit, ", ".join(["fold long", "places array<int>", *[f"{c} long" for c in labels]]))


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and bucket of all features of a batch, and the number of features per row."""
    sizes = np.array([len(v) for v in batch.column("places")], dtype=np.int64)
    return np.repeat(np.arange(batch.num_rows), sizes), batch.column("places").flatten().to_numpy(zero_copy_only=False), sizes


def fit(found: DataFrame, label: str, against: int) -> Head | None:
    """The head of ``label``, whose bad texts have the label ``against``; none unless both labels occur. ``found`` is read twice."""
    rows = found.select("fold", "places", F.col(label).alias("label"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * FOLDS * (BUCKETS + 1), dtype=np.int32)
        for batch in batches:
            row, place, _ = _flat(batch)
            group = (2 * batch.column("fold").to_numpy() + (batch.column("label").to_numpy() == against)) * (BUCKETS + 1)
            np.add.at(counts, group[row] + place, 1)
            # The last place counts the documents.
            np.add.at(counts, group + BUCKETS, 1)
        places = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays([pa.array(places.astype(np.int32)), pa.array(counts[places])], names=["place", "n"])

    # At most one count per fold, label and bucket.
    sums = rows.mapInArrow(count, "place int, n int").groupBy("place").agg(F.sum("n").cast("int").alias("n")).toArrow()
    counts = np.zeros(2 * FOLDS * (BUCKETS + 1), dtype=np.int32)
    counts[sums["place"].to_numpy()] = sums["n"].to_numpy()
    del sums
    counts = counts.reshape(FOLDS, 2, BUCKETS + 1)
    every = counts.sum(axis=0)
    if not every[:, -1].all():
        return None

    def weigh(held: np.ndarray) -> np.ndarray:
        return word_weights(held[:, :-1], held[:, -1]).astype(np.float32)

    weights, others = weigh(every), np.stack([weigh(every - counts[k]) for k in range(FOLDS)])
    del counts
    shared = found.sparkSession.sparkContext.broadcast(others)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            row, place, sizes = _flat(batch)
            w = held[batch.column("fold").to_numpy()[row], place].astype(np.float64)
            sums = [np.bincount(row, np.maximum(x, 0), batch.num_rows).astype(float) for x in (w, -w)]
            bad = (batch.column("label").to_numpy() == against).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*map(pa.array, (*sums, sizes, bad))], names=["against", "for_it", "size", "bad"])

    # At most max_labelled rows of four numbers, in an order that does not depend on the run.
    scored = rows.mapInArrow(score, "against double, for_it double, size long, bad long").where("size > 0").toArrow()
    shared.destroy()
    scored = np.stack([scored[c].to_numpy().astype(float) for c in ("against", "for_it", "size", "bad")])
    scored = scored[:, np.lexsort(scored)]
    if not 0 < scored[3].sum() < scored.shape[1]:
        return None
    coefficients = calibrate(_terms(*scored[:3]), scored[3])
    # The rate of all labels comes from the sites.
    coefficients[0] -= np.log(every[1, -1] / every[0, -1])
    return Head(weights, coefficients, 1 if against else -1)


def evidence(docs: DataFrame, heads: dict[str, Head | None], columns: dict[str, Column], text: str = "text") -> DataFrame:
    """Adds to ``columns`` one evidence column per head."""
    names = list(columns)
    plain = docs.select(*[c.alias(n) for n, c in columns.items()], text_of(text).alias("text"))
    # Arrays of fixed size.
    shared = docs.sparkSession.sparkContext.broadcast(heads)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held = _Words(), shared.value
        for batch in batches:
            sums = {k: np.zeros((3, batch.num_rows)) for k in held}
            for i, value in enumerate(batch.column("text")):
                places = features(value.as_py(), words)
                for k, h in held.items():
                    if h and places:
                        w = h.weights[places].astype(np.float64)
                        sums[k][:, i] = w[w > 0].sum(), -w[w < 0].sum(), len(places)
            values = [h.evidence(*sums[k]) if h else np.zeros(batch.num_rows) for k, h in held.items()]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(v) for v in values], names=[*names, *held])

    kinds = dict(plain.dtypes)
    return plain.mapInArrow(weigh, ", ".join([f"{n} {kinds[n]}" for n in names] + [f"{k} double" for k in heads]))


# -- sites -------------------------------------------------------------------------------


def _strength(groups: DataFrame, mean: Column) -> Column:
    """How many labels a prior is worth, from how far the groups' rates scatter around ``mean`` beyond chance."""
    rate = F.col("_good") / F.col("_n")
    scatter = F.sum(F.col("_n") * (rate - mean) * (rate - mean)) - F.sum(mean * (1 - mean))
    within = F.sum((F.col("_n") - 1) * mean * (1 - mean))
    # Sites that differ no more than by chance share one rate: the prior then weighs as much as any site could.
    strength = F.when(scatter > 0, within / scatter).otherwise(F.lit(1e6))
    return groups.agg(F.least(F.greatest(strength, F.lit(1.0)), F.lit(1e6))).scalar()


def site_rates(labelled: DataFrame, label: str, host: str = "host", path: str = "path") -> DataFrame:
    """(host, path, host_rate, path_rate, host_labels, path_labels, all_rate) of the sites with labels, the first two rates shrunk."""
    good = F.sum(F.col(label).cast("double"))
    per_path = labelled.groupBy(F.col(host).alias("host"), F.col(path).alias("path")).agg(good.alias("_good"), F.count(F.lit(1)).cast("double").alias("_n"))
    per_path = persist_table(per_path, "path-labels")
    per_host = per_path.groupBy("host").agg(F.sum("_good").alias("_good"), F.sum("_n").alias("_n"))
    hosts = per_host.withColumn("all_rate", per_path.agg((F.sum("_good") + 1) / (F.sum("_n") + 2)).scalar())
    hosts = persist_table(hosts, "host-labels")
    hosts = hosts.withColumn("_strength", _strength(hosts, F.col("all_rate")))
    shrunk = (F.col("_good") + F.col("_strength") * F.col("all_rate")) / (F.col("_n") + F.col("_strength"))
    hosts = hosts.select(id_key("host").alias("_host"), shrunk.alias("host_rate"), F.col("_n").cast("long").alias("host_labels"), "all_rate")
    paths = persist_table(per_path.join(hosts, id_key("host") == F.col("_host")).drop("_host"), "path-priors")
    paths = paths.withColumn("_strength", _strength(paths, F.col("host_rate")))
    shrunk = (F.col("_good") + F.col("_strength") * F.col("host_rate")) / (F.col("_n") + F.col("_strength"))
    return paths.select("host", "path", "host_rate", shrunk.alias("path_rate"), "host_labels", F.col("_n").cast("long").alias("path_labels"), "all_rate")


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    path: str = "lang",
    heads: tuple[str, str] = ("quality", "toxic"),
    max_labelled: int = MAX_LABELLED,
) -> DataFrame:
    """One row per document: doc_id, evidence and path rate for both questions, p_quality, p_toxic, kept.

    ``toxic`` is fitted on the documents of good quality, so that its words are not those of good text as such.
    """
    bounded_batches(docs.sparkSession)
    good, toxic = heads
    given = labels.select(F.col(doc_id).alias("_label_id"), F.col(good).cast("int").alias(good), F.col(toxic).cast("int").alias(toxic))
    given = given.where(F.col("_label_id").isNotNull() & F.col(good).isin(0, 1) & F.col(toxic).isin(0, 1))
    # Nothing else of the documents is needed, whatever it is called.
    docs = docs.select(*{c: F.col(c) for c in (doc_id, text, host, path)}.values())
    sample = F.broadcast(given.orderBy(F.xxhash64("_label_id"), "_label_id").limit(max_labelled))
    known = docs.join(sample, F.col(doc_id) == F.col("_label_id")).select(F.col(text).alias("text"), good, toxic)
    found = persist_table(label_features(known, heads), "label-features")
    fitted = {f"{good}_evidence": fit(found, good, 0), f"{toxic}_evidence": fit(found.where(F.col(good) == 1), toxic, 1)}

    sites = docs.select(F.col(doc_id).alias("_doc"), F.col(host).alias("host"), F.col(path).alias("path"))
    sites = sites.join(given, F.col("_doc") == F.col("_label_id"))
    sites = persist_table(sites.select("host", "path", good, toxic), "site-labels")

    columns = {"doc_id": F.col(doc_id), "host": F.col(host), "path": F.col(path)}
    out = evidence(docs, fitted, columns, text)
    for head in heads:
        rates = persist_table(site_rates(sites, head), "site-rates")
        # The rate of a path, of its host, or of all labels.
        overall = rates.agg(F.coalesce(F.max("all_rate"), F.lit(0.5))).scalar()
        by_host = rates.groupBy("host").agg(F.max("host_rate").alias("_host_rate")).select(id_key("host").alias("_h"), "_host_rate")
        by_path = rates.select(id_key("host").alias("_h"), id_key("path").alias("_p"), F.col("path_rate").alias("_path_rate"))
        out = out.withColumns({"_h": id_key("host"), "_p": id_key("path")})
        out = out.join(by_path, ["_h", "_p"], "left").join(by_host, "_h", "left")
        rate = F.coalesce(F.col("_path_rate"), F.col("_host_rate"), overall)
        out = out.withColumn(f"{head}_rate", rate).withColumn(f"p_{head}", 1 / (1 + F.exp(-(F.col(f"{head}_evidence") + _logit(rate)))))
        out = out.drop("_h", "_p", "_path_rate", "_host_rate")
    kept = (F.col(f"p_{good}") >= 0.5) & (F.col(f"p_{toxic}") < 0.5)
    return out.select("doc_id", *[f"{h}_{x}" for h in heads for x in ("evidence", "rate")], *[f"p_{h}" for h in heads], kept.alias("kept"))
