"""Rounding agrees with decimal rounding over all magnitudes, poles and ties included."""

import math
import random
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from ledgerwatch.functions.signals import rounded


def test_rounded_equals_decimal(spark):
    rng = random.Random(11)
    values = [0.0, -0.5, 5e8, 1e12, 1e15, 1e16, 123456789.125, 2.0**40 + 0.5, 1e-7, 4.9999995, 1e300]
    values += [rng.uniform(-1, 1) * 10.0 ** rng.randint(-6, 16) for _ in range(3000)]
    values += [round(rng.uniform(0, 1e6), 2) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for v, got in df.select("v", rounded(F.col("v"), 6)).collect():
        # Within a unit in the last place of a tie, either side will do.
        near = [v, math.nextafter(v, math.inf), math.nextafter(v, -math.inf)]
        exact = [Decimal(x) for x in near] if abs(v) < 1e20 else []
        want = [float(d.quantize(Decimal("0.000001"), rounding=ROUND_HALF_UP)) for d in exact] or [v]
        assert any(abs(got - w) <= 2 * abs(w) * 2**-52 for w in want), (v, got, want)
