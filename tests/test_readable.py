"""Numbers as C prints them."""

import math
import random

from pyspark.sql import functions as F

from loomwright.functions import names as N


def test_fixed_rounds_the_exact_value_and_halves_to_even(spark):
    rng = random.Random(4)
    numbers = [0.5, 1.5, 2.5, 14.5, 16.5, 0.25, 0.75, 1.25, 0.05, 0.15, 0.35, 0.45, 0.3, 0.95, 9.95, 9.96, 99.95, 0.0, -0.3, -2.5, -0.04, 0.49999999999999994, 4503599627370497.5, 1e15, 1e18, 3e18]
    numbers += [k + j / 20 for k in range(60) for j in range(20)] + [rng.randrange(10**9) / 100 for _ in range(2000)] + [rng.random() * 10 ** rng.randrange(-3, 17) for _ in range(3000)]
    numbers += [math.nextafter(x, x + side) for x in numbers[:1000] for side in (1, -1)]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    for r in df.select("x", N.fixed(F.col("x")).alias("none"), N.fixed(F.col("x"), tenths=True).alias("one")).collect():
        assert (r["none"], r["one"]) == (f"{r['x']:.0f}", f"{r['x']:.1f}"), r
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (None,)], "x double")
    assert [r[0] for r in odd.select(N.fixed(F.col("x"))).collect()] == ["nan", "inf", "-inf", None]


def test_money_and_hours(spark):
    df = spark.createDataFrame([(16_500.0, 7380.0), (17_500.0, 9900.0), (1_250_000.0, 8100.0), (1_350_000.0, 119.9), (None, None)], "value double, seconds double")
    got = [tuple(r) for r in df.select(N.dollars(F.col("value")), N.duration(F.col("seconds"))).collect()]
    assert got == [("$16k", "2.0 h"), ("$18k", "2.8 h"), ("$1.2M", "2.2 h"), ("$1.4M", "119 s"), (None, None)]
