import numpy as np
import pandas as pd

from fleetlake.operators.growing import (
    RANK_ERROR,
    add_file,
    file_state,
    merge_states,
    merged_features,
    sketched_describe,
    sketched_quantiles,
    states,
)
from fleetlake.operators.profile import column_features
from fleetlake.operators.runlog import decode_variant, summary_fields
from fleetlake.session import scratch_path

SCHEMA = "k bigint, x double, t string, flag boolean"


def _rows(rng, n, shift):
    return [
        (
            i,
            [float(rng.normal(1e6 + shift, 3)), None, float("nan")][int(rng.choice(3, p=[0.9, 0.05, 0.05]))],
            None if i % 7 == 0 else f"t{i % 3}",
            i % 2 == 0,
        )
        for i in range(n)
    ]


def test_states_of_files_give_the_profile_of_their_union(spark):
    rng, table = np.random.default_rng(3), scratch_path(spark, "grow")
    parts = [spark.createDataFrame(_rows(rng, n, s), SCHEMA) for n, s in ((500, 0), (3000, 50), (1, 9))]
    for i, p in enumerate(parts):
        add_file(spark, table, p, f"f{i}")
    add_file(spark, table, parts[0], "f1")
    add_file(spark, table, parts[1], "f1")  # the same file again replaces its state
    union = parts[0].unionByName(parts[1]).unionByName(parts[2])
    got = sorted(map(tuple, merged_features(spark, table).collect()))
    assert got == sorted(map(tuple, column_features(union).collect()))
    x = pd.Series([r.x for r in union.select("x").collect()], dtype=float).dropna()
    d = {r.column_name: r for r in sketched_describe(merge_states(states(spark, table))).collect()}
    assert set(d) == {"k", "x"}
    assert d["x"]["count"] == len(x) and d["x"].min == x.min() and d["x"].max == x.max()
    assert abs(d["x"].mean - x.mean()) < 1e-6 and abs(d["x"].std / x.std() - 1) < 1e-9


def test_quantiles_are_within_the_stated_rank_error(spark):
    rng = np.random.default_rng(4)
    # a third of the rows is one value; the rest is skewed, in files of very different sizes
    values = np.concatenate([np.full(20000, 5.0), rng.lognormal(0, 2, 40000)])
    rng.shuffle(values)
    table, cuts = scratch_path(spark, "sketch"), [0, 10, 3000, 20000, 60000]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        add_file(spark, table, spark.createDataFrame(pd.DataFrame({"v": values[a:b]})), f"{a}")
    probs = [0.0, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]
    found = sketched_quantiles(merge_states(states(spark, table)), probs).collect()
    assert len(found) == len(probs)
    for r in found:
        low, high = (values < r.quantile).mean(), (values <= r.quantile).mean()
        assert low - RANK_ERROR <= r.p <= high + RANK_ERROR and r.quantile in values


def test_empty_files_missing_columns_and_one_scan(spark):
    table = scratch_path(spark, "grow-odd")
    df = spark.createDataFrame([(1, 2.0, "a", None)], SCHEMA)
    add_file(spark, table, df.limit(0), "empty")
    assert sketched_describe(merge_states(states(spark, table))).collect() == []
    assert {r.row_count for r in merged_features(spark, table).collect()} == {0}
    add_file(spark, table, df, "one")
    add_file(spark, table, df.select("k"), "narrow")
    rows = {r.column_name: r for r in merged_features(spark, table).collect()}
    assert (rows["k"].row_count, rows["x"].row_count, rows["flag"].missing_count) == (2, 1, 1)
    stored = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    plan = file_state(stored, "e")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_summaries_of_any_shape(spark):
    texts = ['{"a": 1, "b": {"c": "x"}}', '{"a": 2.5}', "", None, "not json", "[1, 2]"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, summary_json string")
    rows = {r.id: r for r in decode_variant(df).selectExpr(
        "id", "try_variant_get(summary, '$.a', 'double') a", "try_variant_get(summary, '$.b.c', 'string') c", "summary IS NULL n"
    ).collect()}
    assert [(rows[i].a, rows[i].c, rows[i].n) for i in range(6)] == [
        (1.0, "x", False), (2.5, None, False), (None, None, True), (None, None, True), (None, None, True), (None, None, False)
    ]
    assert summary_fields(df.filter("id < 2")) == "OBJECT<a: DECIMAL(21,1), b: OBJECT<c: STRING>>"
