"""Ranking and label metrics over a table of scores and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerwatch.functions.signals import ratio
from ledgerwatch.operators.ordering import cumulative_by_value
from ledgerwatch.schema import DEFAULT_THRESHOLD, KS_MIN_ROWS


def _count(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0).cast("bigint")


def _by_score(df: DataFrame, score: str, label: str, keys: list[str]) -> DataFrame:
    weights = {"pos": _count(F.col(label)), "neg": _count(~F.col(label))}
    return cumulative_by_value(df, score, weights, keys)


def auc(df: DataFrame, score: str, label: str, keys: list[str] = ()) -> DataFrame:
    """Probability that a positive outranks a negative, ties counting half; null with one class only."""
    points = _by_score(df, score, label, list(keys))
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / F.lit(2.0)))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return points.groupBy(*keys).agg(ratio(wins, pairs).alias("auc"))


def average_precision(df: DataFrame, score: str, label: str, keys: list[str] = ()) -> DataFrame:
    """Sum over distinct scores, highest first, of the gain in recall times the precision there."""
    keys = list(keys)
    points = _by_score(df, score, label, keys)
    all_pos, all_rows = F.col("pos_total"), F.col("pos_total") + F.col("neg_total")
    tp = all_pos - F.col("pos_before")
    flagged = all_rows - F.col("pos_before") - F.col("neg_before")
    gain = ratio(F.col("pos"), all_pos) * ratio(tp, flagged)
    return points.groupBy(*keys).agg(F.sum(gain).alias("average_precision"))


def log_loss(df: DataFrame, score: str, label: str, floor: float = 1e-15) -> DataFrame:
    p = F.least(F.greatest(F.col(score), F.lit(floor)), F.lit(1 - floor))
    return df.agg(F.avg(-F.when(F.col(label), F.ln(p)).otherwise(F.ln(1 - p))).alias("log_loss"))


def confusion(predicted: Column, label: Column) -> list[Column]:
    cells = {"tp": predicted & label, "fp": predicted & ~label, "fn": ~predicted & label, "tn": ~predicted & ~label}
    return [F.sum(_count(c)).alias(n) for n, c in cells.items()]


def classification_metrics(df: DataFrame, score: str, label: str, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Precision, recall and F1 at a threshold; an undefined ratio counts as 0."""
    cells = df.agg(*confusion(F.col(score) >= threshold, F.col(label)))
    tp = F.col("tp")
    zero = F.lit(0.0)
    return cells.select(
        "tp", "fp", "fn", "tn",
        F.coalesce(ratio(tp, tp + F.col("fp")), zero).alias("precision"),
        F.coalesce(ratio(tp, tp + F.col("fn")), zero).alias("recall"),
        F.coalesce(ratio(2 * tp, 2 * tp + F.col("fp") + F.col("fn")), zero).alias("f1"),
    )


def threshold_table(df: DataFrame, score: str, label: str, fraud_rate: Column | None = None) -> DataFrame:
    """Measures at the thresholds .01 to .99; scores are binned first, so 100 rows remain to be ordered."""
    bin_ = F.least(F.floor(F.col(score) * 100 + F.lit(1e-9)), F.lit(99)).cast("int")
    bins = df.groupBy(bin_.alias("k")).agg(
        F.sum(_count(F.col(label))).alias("pos"), F.count(F.lit(1)).alias("rows")
    )
    grid = df.sparkSession.range(0, 100).select(F.col("id").cast("int").alias("k"))
    filled = grid.join(bins, "k", "left").na.fill(0)
    from_top = Window.partitionBy(F.lit(0)).orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    everywhere = Window.partitionBy(F.lit(0))
    swept = filled.select(
        "k",
        F.sum("pos").over(from_top).alias("tp"),
        F.sum("rows").over(from_top).alias("flagged"),
        F.sum("pos").over(everywhere).alias("all_pos"),
        F.sum("rows").over(everywhere).alias("all_rows"),
    )
    rate = fraud_rate if fraud_rate is not None else ratio(F.col("all_pos"), F.col("all_rows"))
    precision, recall = ratio(F.col("tp"), F.col("flagged")), ratio(F.col("tp"), F.col("all_pos"))
    share = ratio(F.col("flagged"), F.col("all_rows"))
    zero = F.lit(0.0)
    return swept.where("k >= 1").select(
        (F.col("k") / F.lit(100.0)).alias("threshold"),
        "tp",
        "flagged",
        F.coalesce(ratio(1.25 * precision * recall, 0.25 * precision + recall), zero).alias("f05"),
        F.coalesce(ratio(2 * precision * recall, precision + recall), zero).alias("f1"),
        F.coalesce((share >= 0.5 * rate) & (share <= 3.0 * rate), F.lit(False)).alias("admissible"),
    )


def best_threshold(table: DataFrame) -> DataFrame:
    """The smallest admissible threshold with the highest F0.5; .5 and zeros where none qualifies."""
    usable = table.where(F.col("admissible") & (F.col("f05") > 0))
    top = usable.agg(F.max_by(F.struct("threshold", "f05", "f1"), F.struct("f05", -F.col("threshold"))).alias("best"))
    return top.select(
        F.coalesce("best.threshold", F.lit(DEFAULT_THRESHOLD)).alias("best_threshold"),
        F.coalesce("best.f05", F.lit(0.0)).alias("best_f05"),
        F.coalesce("best.f1", F.lit(0.0)).alias("f1_at_best_threshold"),
    )


def class_balance(df: DataFrame, label: str, min_rows: int) -> DataFrame:
    """Rows, classes, weight of the positive class, and whether training may start."""
    counts = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(_count(F.col(label))).alias("n_pos"))
    counts = counts.select("rows", F.coalesce("n_pos", F.lit(0)).alias("n_pos"))
    counts = counts.withColumn("n_neg", F.col("rows") - F.col("n_pos"))
    verdict = (
        F.when(F.col("rows") < min_rows, "too_few_rows")
        .when((F.col("n_pos") == 0) | (F.col("n_neg") == 0), "single_class")
        .otherwise("ok")
    )
    return counts.select(
        "*",
        ratio(F.col("n_pos"), F.col("rows")).alias("fraud_rate"),
        ratio(F.col("n_neg"), F.greatest("n_pos", F.lit(1))).alias("positive_weight"),
        verdict.alias("verdict"),
    )


def ks_two_sample(df: DataFrame, value: str, is_live: str, min_rows: int = KS_MIN_ROWS) -> DataFrame:
    """Largest gap between the two empirical distributions and its asymptotic p-value.

    Null where either side has fewer than ``min_rows`` values.
    """
    return ks_of_counts(df, value, _count(~F.col(is_live)), _count(F.col(is_live)), min_rows)


def ks_of_counts(df: DataFrame, value: str, a: Column, b: Column, min_rows: int = KS_MIN_ROWS) -> DataFrame:
    """As :func:`ks_two_sample`, from rows that stand for ``a`` values of one side and ``b`` of the other."""
    points = cumulative_by_value(df, value, {"a": a, "b": b})
    na, nb = F.col("a_total"), F.col("b_total")
    gap = F.abs(ratio(F.col("a_before") + F.col("a"), na) - ratio(F.col("b_before") + F.col("b"), nb))
    found = points.agg(F.max(gap).alias("d"), F.max(na).alias("na"), F.max(nb).alias("nb"))
    enough = (F.col("na") >= min_rows) & (F.col("nb") >= min_rows)
    scale = F.sqrt(ratio(F.col("na") * F.col("nb"), F.col("na") + F.col("nb")))
    return found.select(
        F.when(enough, F.col("d")).alias("ks_statistic"),
        F.when(enough, kolmogorov(F.col("d") * scale)).alias("ks_pvalue"),
    )


def kolmogorov(x: Column, terms: int = 100) -> Column:
    """Survival function of the Kolmogorov distribution."""
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * x * x),
    )
    # The series does not converge near 0, where the value is 1.
    return F.when(x < 0.2, 1.0).otherwise(F.least(F.greatest(2.0 * series, F.lit(0.0)), F.lit(1.0)))
