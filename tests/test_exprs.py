import pytest
from pyspark.sql import functions as F

from fleetlake.functions.exprs import clip, exact_mean_tenths, lookup, mean, r1, safe_div


def test_clip_keeps_nulls_and_bounds(spark):
    df = spark.createDataFrame([(None,), (-3.0,), (5.0,), (120.0,)], "x double")
    got = [r[0] for r in df.select(clip("x", 0, 100)).collect()]
    assert got == [None, 0.0, 5.0, 100.0]


def test_r1_is_half_even_on_tenths(spark):
    # rint(x*10)/10: 0.25 -> 0.2, 0.35 -> 0.4 (0.35*10 = 3.5 exactly -> 4), 2.25 -> 2.2
    df = spark.createDataFrame([(0.25,), (0.35,), (2.25,), (28.0,), (-1.25,)], "x double")
    got = [r[0] for r in df.select(r1("x")).collect()]
    assert got == [0.2, 0.4, 2.2, 28.0, -1.2]


def test_safe_div_follows_pandas(spark):
    df = spark.createDataFrame([(1.0, 0), (0.0, 0), (None, 2), (3.0, 2), (-1.0, 0)], "n double, d int")
    got = [r[0] for r in df.select(safe_div("n", "d")).collect()]
    assert got == [float("inf"), None, None, 1.5, float("-inf")]


def test_lookup_missing_and_null_key(spark):
    df = spark.createDataFrame([("a",), ("zzz",), (None,)], "k string")
    got = [r[0] for r in df.select(lookup({"a": "A"}, F.col("k"))).collect()]
    assert got == ["A", None, None]


def test_exact_means_do_not_depend_on_partitioning(spark):
    vals = [(i % 7, (i * 37 % 1000) / 10.0) for i in range(5000)]
    df = spark.createDataFrame(vals, "g int, x double")
    outs = {df.repartition(n).agg(exact_mean_tenths("x").alias("t")).first().t for n in (1, 3, 17)}
    assert len(outs) == 1
    assert abs(outs.pop() - sum(v for _, v in vals) / len(vals)) < 1e-9


def test_means_of_tiny_huge_and_fractional_values_match_pandas(spark):
    import pandas as pd

    for vals in ([1e-7, 3e-7], [1e33, 1.0], [0.5, 1.5], [1.0, 1e13, 5e13, 9e13], [float("inf"), 1.0], [None, 2.5]):
        got = spark.createDataFrame([(v,) for v in vals], "x double").agg(mean("x").alias("m")).first().m
        assert got == pytest.approx(pd.Series(vals, dtype="float64").mean(), rel=1e-14)
