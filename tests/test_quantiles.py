"""Percentiles by selection against sorted lists."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from callgrain.operators import benchmarks, profile
from callgrain.operators.quantiles import quantiles

SHARES = [0.0, 0.3, 0.5, 0.95, 1.0]


def groups():
    rng = random.Random(1)
    yield "normal", [rng.gauss(0, 1) for _ in range(500)]
    yield "ints", [float(rng.randint(1, 40)) for _ in range(700)]
    yield "one value", [7.0] * 300
    yield "single", [-2.5]
    yield "two", [1.0, 2.0]
    yield "wide", [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-320, 308) for _ in range(600)] + [0.0, -0.0, 5e-324]
    yield "close", [1.0 + k * 2.0**-52 for k in range(300)] * 2
    yield "hot", [3.0] * 2000 + [3.0000001, 2.9]
    yield None, [1e18 + k for k in range(0, 4000, 7)]


@pytest.mark.parametrize(("few", "slices"), [(200_000, 4096), (10, 4096), (0, 4096)])
def test_equal_to_sorted_values(spark, few, slices):
    rows = [(g, x) for g, xs in groups() for x in xs] + [("normal", None), ("ints", math.nan), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {r.g: r for r in quantiles(df, "x", SHARES, "g", few=few, slices=slices).collect()}
    assert set(got) == {g for g, _ in groups()}
    for g, xs in groups():
        r = got[g]
        assert (r.n, r.least, r.most) == (len(xs), min(xs), max(xs))
        for k, s in enumerate(SHARES):
            p = s * (len(xs) - 1)
            a, b = sorted(xs)[math.floor(p)], sorted(xs)[math.ceil(p)]
            want = a if p == math.floor(p) else (1 - (p - math.floor(p))) * a + (p - math.floor(p)) * b
            assert r[f"q{k}"] == pytest.approx(want, rel=1e-12, abs=0), (g, s)


def test_infinite_values_and_no_rows(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, math.inf, -math.inf, 2.0, 3.0)], "x double")
    assert quantiles(df, "x", [0.5, 1.0]).first().q0 == 2.0
    assert quantiles(df, "x", [1.0]).first().q0 == np.finfo(float).max
    assert quantiles(df.filter("x IS NULL"), "x", [0.5]).count() == 0
    empty = profile.length_profile(df.filter("x IS NULL"), "x").first()
    assert empty.n == 0 and empty.p50 is None and empty.longest is None
    assert benchmarks.latency(df.filter("x IS NULL"), "x").first().p95 is None


def test_same_as_the_aggregate(spark):
    df = spark.range(20_000).select((F.col("id") % 7).alias("g"), (F.xxhash64("id") % 1000 / 8.0).alias("x"))
    want = {r.g: r for r in df.groupBy("g").agg(F.percentile("x", F.lit(0.5)).alias("p50"), F.percentile("x", F.lit(0.95)).alias("p95"), F.stddev_pop("x").alias("s")).collect()}
    for r in benchmarks.latency(df, "x", "g").collect():
        assert (r.p50, r.p95) == pytest.approx((want[r.g].p50, want[r.g].p95)) and r.stddev == pytest.approx(want[r.g].s)
    # nothing gathers a group's values
    plan = benchmarks.latency(df, "x", "g")._jdf.queryExecution().toString().lower()
    assert "percentile" not in plan and "collect_list" not in plan
