"""Cumulative sums and exact percentiles over ordered values, by radix digits instead of a global sort.

Every value has a whole-number code that grows with it: its sign and 41 bits of its logarithm, which Java computes
monotonically. The upper bits are one digit, the lower 20 another, and at most some four million different doubles share
a code. So a digit has a bounded number of values whatever the data, and sums up to a value are sums over the smaller
first digits, over the smaller second digits within the same first one, and over the smaller values within the same code.
No task orders more than that, and nothing about the data has to be known beforehand.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Bits of the second digit.
_LOW = 20
# Logarithms of doubles lie between -745.2 and 709.8; infinity counts as 710.
_LEAST, _MOST = 746, 710.0
_NAN_CODE = 1 << 42
_NULL_CODE = -(1 << 60)


def code_of(x: Column) -> Column:
    """A bigint that grows with a double, in steps of about 2^-30 of the value; NaN comes last, null is null."""
    size = F.least(F.ln(F.abs(x)), F.lit(_MOST)) + F.lit(float(_LEAST))
    steps = F.floor(size * F.lit(float(1 << (10 + _LOW)))) + 1
    return F.when(F.isnan(x), F.lit(_NAN_CODE)).when(x == 0, F.lit(0)).when(x > 0, steps).otherwise(-steps).cast("bigint")


def _high(code: Column) -> Column:
    return F.shiftright(code, _LOW)


def _upto(keys: list[str], order: str | Column) -> Window:
    return Window.partitionBy(*(keys or [F.lit(0)])).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def cumulative_by_value(df: DataFrame, value: str, weights: dict[str, Column], keys: list[str] = ()) -> DataFrame:
    """One row per key and distinct value: each weight summed at the value, as ``<name>_before`` below it, and as
    ``<name>_total`` over all values of the key."""
    keys, names = list(keys), list(weights)
    points = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(*[F.sum(w).alias(n) for n, w in weights.items()])
    points = points.withColumn("_code", code_of(F.col(value).cast("double"))).withColumn("_high", _high(F.col("_code")))
    by_code = points.groupBy(*keys, "_high", "_code").agg(*[F.sum(n).alias(n) for n in names])
    by_high = by_code.groupBy(*keys, "_high").agg(*[F.sum(n).alias(n) for n in names])

    everything = Window.partitionBy(*(keys or [F.lit(0)]))
    totals = [F.sum(n).over(everything).alias(f"{n}_total") for n in names]
    before = [F.coalesce(F.sum(n).over(_upto(keys, "_high")), F.lit(0)).alias(n) for n in names]
    carry = by_high.select(*keys, "_high", *before, *totals)
    # A carry row has no code, or no value, and so comes first.
    carry = _carried(by_code, carry, [*keys, "_high"], "_code", names)
    rows = _carried(points, carry, [*keys, "_high", "_code"], value, names, keep=True)
    return rows.drop("_high", "_code")


def _carried(rows: DataFrame, carry: DataFrame, groups: list[str], order: str, names: list[str], keep: bool = False) -> DataFrame:
    """For each row the sums before it within its group, which start from the group's carry row, and the totals."""
    both = rows.unionByName(carry, allowMissingColumns=True)
    before = {n: F.coalesce(F.sum(n).over(_upto(groups, F.col(order).asc_nulls_first())), F.lit(0)) for n in names}
    totals = [F.max(f"{n}_total").over(Window.partitionBy(*groups)).alias(f"{n}_total") for n in names]
    if keep:
        sums = [*[F.col(n) for n in names], *[c.alias(f"{n}_before") for n, c in before.items()]]
    else:
        sums = [c.alias(n) for n, c in before.items()]
    others = [c for c in rows.columns if c not in names]
    return both.select(*others, *sums, *totals).where(F.col(order).isNotNull())


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> DataFrame:
    """Inner join on equal or equally missing keys; ``b`` has a few rows per key, measure and share, and is broadcast."""
    renamed = b.select(*[F.col(c).alias(f"_r_{c}") if c in names else F.col(c) for c in b.columns])
    on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in names])
    return a.join(F.broadcast(renamed), on).drop(*[f"_r_{c}" for c in names])


def selected(
    df: DataFrame, measures: dict[str, tuple[Column, dict[str, float]]], keys: list[str] = (), totals: dict[str, Column] | None = None
) -> DataFrame:
    """Exact percentiles with linear interpolation of several measures, and sums, one row per key (one without keys).

    ``measures`` has for each measure its column and the shares wanted of it by the names of the results; ``totals`` are
    expressions to sum up over all rows. Three scans: the first counts values per first digit, the others look only at
    the digits, and then the codes, in which a wanted rank lies. Only counts are shuffled, and rows do not travel to the
    digits, of which a value that most rows have would fill one. The keys have to be few, such as features or minutes.
    """
    keys, totals = list(keys), dict(totals or {})
    sums = list(totals)
    value = F.array(*[F.struct(F.lit(m).alias("_measure"), x.cast("double").alias("_value")) for m, (x, _) in measures.items()])
    rows = df.select(*keys, *[c.alias(n) for n, c in totals.items()], F.inline(value))
    rows = rows.withColumn("_code", F.coalesce(code_of(F.col("_value")), F.lit(_NULL_CODE))).withColumn("_high", _high(F.col("_code")))
    groups = [*keys, "_measure"]

    def ranks_of(share: float) -> tuple[Column, Column]:
        rank = (F.col("_all") - 1) * F.lit(float(share))
        return F.floor(rank), F.ceil(rank)

    wanted = F.array().cast("array<bigint>")
    for m, (_, shares) in measures.items():
        ranks = F.array_distinct(F.array(*[r for s in shares.values() for r in ranks_of(s)])) if shares else wanted
        wanted = F.when(F.col("_measure") == m, ranks).otherwise(wanted)

    def those_inside(counted: DataFrame, within: list[str], order: str) -> DataFrame:
        """The groups in which wanted ranks lie; a measure without values keeps its one group."""
        placed = counted.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_n").over(_upto(within, order)), F.lit(0)))
        inside = F.filter("_want", lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_n")))
        return placed.withColumn("_want", inside).where((F.size("_want") > 0) | (F.col("_all") == 0))

    kept = ["_want", "_before", "_all", *sums]

    def counts(part: DataFrame, by: list[str]) -> DataFrame:
        # What is kept is the same for all rows of a group; as part of the key it is aggregated by hash before the shuffle.
        return part.groupBy(*by, *kept).agg(F.count("_value").alias("_n")).select(*by, "_n", *kept)

    whole = Window.partitionBy(*groups)
    first = rows.groupBy(*groups, "_high").agg(F.count("_value").alias("_n"), *[F.sum(n).alias(n) for n in sums])
    first = first.withColumns({"_all": F.sum("_n").over(whole), **{n: F.sum(n).over(whole) for n in sums}})
    first = first.withColumns({"_want": wanted, "_before": F.lit(0).cast("bigint")})
    marks = those_inside(first, groups, "_high").select(*groups, "_high", *kept)

    plain = rows.drop(*sums)
    second = counts(_same(plain, marks, [*groups, "_high"]), [*groups, "_high", "_code"])
    marks = those_inside(second, [*groups, "_high"], "_code").select(*groups, "_code", *kept)
    third = counts(_same(plain.drop("_high"), marks, [*groups, "_code"]), [*groups, "_code", "_value"])
    found = those_inside(third, [*groups, "_code"], "_value")

    picked, results = [], []
    for m, (_, shares) in measures.items():
        for name, share in shares.items():
            low, high = ranks_of(share)
            for end, rank in (("lo", low), ("hi", high)):
                here = (F.col("_measure") == m) & F.array_contains("_want", rank)
                picked.append(F.max(F.when(here, F.col("_value"))).alias(f"_{end}_{name}"))
            rank = (F.col("_all") - 1) * F.lit(float(share))
            picked.append(F.max(F.when(F.col("_measure") == m, rank - F.floor(rank))).alias(f"_part_{name}"))
            results.append((F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * F.col(f"_part_{name}")).alias(name))
    one = next(iter(measures))
    picked += [F.max(F.when(F.col("_measure") == one, F.col(n))).alias(n) for n in sums]
    picked.append(F.max("_all").alias("_most"))
    return found.groupBy(*keys).agg(*picked).select(*keys, *results, *sums, "_most")


def percentiles(df: DataFrame, value: str, shares: dict[str, float], keys: list[str] = ()) -> DataFrame:
    """Exact percentiles of one column, one row per key that has values (one row without keys)."""
    found = selected(df, {value: (F.col(value), shares)}, keys)
    return (found.where(F.col("_most") > 0) if keys else found).drop("_most")
