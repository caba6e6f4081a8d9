import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetlake.operators import analysis as an

RUNS = [
    ("r1", "Meridian", "forecast", 83.1, 60, 4, 6, 2.5, 231.5),
    ("r2", "Meridian", "forecast", 69.3, 60, 5, 7, 1.0, 220.0),
    ("r3", "Nova", "orders", 31.4, 45, 0, 1, 0.0, 95.4),
    ("r4", "Nova", "orders", 64.4, 45, 3, 4, 3.3, 150.0),
]
SCHEMA = (
    "run_id string, account string, workload string, duration_minutes double, sla_minutes int, "
    "error_count int, retry_count int, shuffle_spill_gb double, cost_usd double"
)


def test_risk_ranking_matches_pandas(spark):
    df = spark.createDataFrame(RUNS, SCHEMA)
    got = an.workload_risk(df).collect()
    p = pd.DataFrame(RUNS, columns=[c.split()[0] for c in SCHEMA.split(", ")])
    p["over"] = (p.duration_minutes - p.sla_minutes).clip(lower=0)
    p["risk"] = p.over + p.error_count * 8 + p.retry_count * 3 + p.shuffle_spill_gb * 0.5
    want = p.groupby(["account", "workload"]).risk.mean().sort_values(ascending=False)
    assert [(r.account, r.workload) for r in got] == list(want.index)
    for r, w in zip(got, want.values):
        assert abs(r.risk_score - w) < 1e-9


def test_choose_analysis_branches(spark):
    runs = spark.createDataFrame(RUNS, SCHEMA)
    assert an.choose_analysis(runs, "risk?")[0] == "risk"
    cat = runs.select("account", "cost_usd", "duration_minutes")
    kind, params = an.choose_analysis(cat, "compare cost_usd by account")
    assert kind == "category" and params == {"category": "account", "metric": "cost_usd"}
    assert an.choose_analysis(runs.select("cost_usd"), "x")[0] == "numeric"
    assert an.choose_analysis(runs.select("account"), "x")[0] == "preview"


def test_preferred_column():
    cols = ["region", "team_name", "account"]
    assert an.preferred_column(cols, "by ACCOUNT please", ["team"]) == "account"
    assert an.preferred_column(cols, "anything", ["customer", "team"]) == "team_name"
    assert an.preferred_column(cols, "anything", ["zzz"]) == "region"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(min_value=-1e4, max_value=1e4, allow_nan=False).map(lambda x: round(x, 3)), min_size=1, max_size=60))
def test_describe_matches_pandas(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = an.numeric_describe(df, "v").first()
    want = pd.Series(values).describe()
    assert got["count"] == want["count"]
    for ours, theirs in [("mean", "mean"), ("min", "min"), ("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("max", "max")]:
        assert abs(got[ours] - want[theirs]) <= 1e-9 * max(1.0, abs(want[theirs])), ours
    if len(values) > 1:
        assert abs(got["std"] - want["std"]) <= 1e-6 * max(1.0, want["std"])
    else:
        assert got["std"] is None


def test_quantiles_are_numpy_linear(spark):
    vals = [float(x) for x in np.random.default_rng(3).normal(size=997)]
    df = spark.createDataFrame([(v,) for v in vals], "v double").repartition(7)
    q = an.exact_quantiles(df, "v", [0.1, 0.5, 0.9]).first()
    for got, p in zip(q, [0.1, 0.5, 0.9]):
        assert got == float(np.percentile(vals, p * 100))


def test_histogram_single_value_is_one_bin(spark):
    df = spark.createDataFrame([(2.0,)] * 5, "v double")
    out = an.histogram(df, "v", 10).collect()
    assert [(r.bin, r.bin_start, r.bin_end, r["count"]) for r in out] == [(0, 2.0, 2.0, 5)]


def test_histogram_counts_all_rows(spark):
    df = spark.range(1000).selectExpr("cast(id as double) / 7 as v")
    out = an.histogram(df, "v", 10).collect()
    assert sum(r["count"] for r in out) == 1000 and len(out) == 10


def test_keyword_order_when_no_column_is_named(spark):
    runs = spark.createDataFrame(RUNS, SCHEMA).select("account", "cost_usd", "duration_minutes")
    assert an.choose_analysis(runs, "what does it cost?")[1]["metric"] == "duration_minutes"


def test_nan_and_infinity_follow_pandas(spark):
    rows = [("a", 1.0), ("a", float("nan")), ("a", 3.0), ("b", float("inf")), ("b", 1.0), ("c", float("-inf")), ("c", float("inf"))]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r for r in an.category_summary(df, "g", "x").collect()}
    p = pd.DataFrame(rows, columns=["g", "x"]).groupby("g").x.agg(["count", "mean", "min", "max"])
    assert got["a"]["count"] == p.loc["a", "count"] == 2
    assert got["a"]["mean"] == p.loc["a", "mean"] == 2.0 and got["a"]["max"] == 3.0
    assert got["b"]["mean"] == float("inf") == p.loc["b", "mean"]
    assert np.isnan(got["c"]["mean"]) and np.isnan(p.loc["c", "mean"])


def test_describe_with_infinity(spark):
    vals = [1.0, 2.0, float("inf")]
    got = an.numeric_describe(spark.createDataFrame([(v,) for v in vals], "v double"), "v").first()
    want = pd.Series(vals).describe()
    assert got["mean"] == want["mean"] == float("inf")
    assert np.isnan(got["std"]) and np.isnan(want["std"])
    assert got["max"] == float("inf") and got["p25"] == want["25%"]


def test_numeric_chart_table_is_the_histogram(spark):
    df = spark.range(100).selectExpr("cast(id as double) as cost")
    a = an.auto_analyze(df, "cost spread")
    assert a.kind == "numeric"
    bins = an.chart_table(a).collect()
    assert sum(r["count"] for r in bins) == 100 and len(bins) == 10


def test_histogram_ignores_infinities(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("inf"),), (float("nan"),)], "v double")
    out = an.histogram(df, "v", 2).collect()
    assert [(r.bin, r["count"]) for r in out] == [(0, 1), (1, 1)]


@pytest.mark.parametrize(
    "vals", [[1e-7, 3e-7], [1.0, 1e13, 5e13, 9e13], [1e9 + 0.25, 1e9 + 0.5, 1e9 + 0.75], [0.0] * 700 + [0.5, 1.5, 2.5]]
)
def test_describe_matches_pandas_at_any_magnitude(spark, vals):
    want = pd.Series(vals).describe()
    got = an.numeric_describe(spark.createDataFrame([(v,) for v in vals], "x double").repartition(5), "x").first()
    for a, b in [("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"), ("25%", "p25"), ("50%", "p50"),
                 ("75%", "p75"), ("max", "max")]:
        assert got[b] == pytest.approx(want[a], rel=1e-9), a


def test_a_value_in_most_rows_is_one_counted_row(spark):
    df = spark.range(20000).selectExpr("if(id % 3 < 2, 0.0, id * 1.0) as x")
    want = np.quantile([0.0 if i % 3 < 2 else float(i) for i in range(20000)], [0.25, 0.5, 0.75])
    assert tuple(an.exact_quantiles(df, "x", [0.25, 0.5, 0.75]).first()) == pytest.approx(tuple(want))
