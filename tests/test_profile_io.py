import os
import tempfile

import pytest

from fleetlake.operators.analysis import mean_by_group
from fleetlake.operators.profile import column_features, profile_summary
from fleetlake.session import scratch_path
from fleetlake.sources.files import csv_scan, read_dataset, read_parquet_dataset, write_csv
from fleetlake.sources.records import records_json


def _csv(text: str) -> str:
    d = tempfile.mkdtemp(prefix="fl-csv-")
    p = os.path.join(d, "data.csv")
    with open(p, "w") as f:
        f.write(text)
    return p


def test_missing_tokens_and_types(spark):
    p = _csv(
        "name,n,x,flag,day,cat\n"
        "a,1,1.5,True,2024-01-02,none\n"
        "b,NA,n/a,False,2024-01-03,NULL\n"
        "c,3,NaN,,#N/A,skewed_shuffle\n"
    )
    df = csv_scan(spark, p)
    types = dict(df.dtypes)
    assert types == {"name": "string", "n": "bigint", "x": "double", "flag": "boolean", "day": "date", "cat": "string"}
    rows = df.orderBy("name").collect()
    assert rows[1].n is None and rows[1].x is None and rows[2].x is None and rows[2].day is None
    assert rows[0].cat == "none"  # lower-case 'none' is a value, not a missing token
    assert rows[1].cat is None


def test_two_row_materialisation_counts(spark):
    p = _csv("account,duration_minutes\nNova,34.2\nAtlas,29.1\n")
    feats = column_features(csv_scan(spark, p)).collect()
    assert len(feats) == 2 and all(f.row_count == 2 and f.missing_count == 0 for f in feats)


def test_mean_by_account_golden(spark):
    df = spark.createDataFrame([("Nova", 34.2), ("Nova", 41.7), ("Atlas", 29.1)], "account string, duration_minutes double")
    got = [tuple(r) for r in mean_by_group(df, "account", "duration_minutes").collect()]
    assert got == [("Nova", 37.95), ("Atlas", 29.1)]


def test_nan_counts_as_missing_and_profile_shape(spark):
    df = spark.createDataFrame([(1, float("nan"), "a"), (2, None, None), (3, 1.0, "c")], "id int, v double, s string")
    feats = {r.column_name: r.missing_count for r in column_features(df).collect()}
    assert feats == {"id": 0, "v": 2, "s": 1}
    p = profile_summary(df, "t.csv", ["id"]).first()
    assert p.rows == 3 and p.columns == 3 and p.numeric_columns == ["id", "v"] and p.categorical_columns == ["s"]
    assert p.sample_rows.startswith('[{"id":1,"v":null,"s":"a"}')


def test_missing_parquet_reads_empty(spark):
    df = read_parquet_dataset(spark, "/nonexistent/fleetlake/table", "a int")
    assert df.count() == 0 and df.columns == ["a"]


def test_excel_is_rejected(spark):
    import pytest

    with pytest.raises(ValueError):
        read_dataset(spark, "/x/data.xlsx")


def test_records_use_second_precision_timestamps(spark):
    import datetime as dt

    df = spark.createDataFrame([(dt.datetime(2024, 4, 24, 9, 13, 5, 123), float("nan"))], "ts timestamp_ntz, v double")
    assert records_json(df).first()[0] == '{"ts":"2024-04-24T09:13:05","v":null}'


def test_numeric_inference_is_strict_about_text_shape(spark):
    p = _csv("a,b,c,d\n1,1.5,1d,+3\n2,2,2,-4\n3,1e3,3,5\n")
    types = dict(csv_scan(spark, p).dtypes)
    assert types == {"a": "bigint", "b": "double", "c": "string", "d": "bigint"}
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        assert dict(csv_scan(spark, p).dtypes) == types
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")


def test_csv_dates_are_categorical(spark):
    from fleetlake.operators.profile import categorical_columns, numeric_columns

    p = _csv("run_date,account,cost\n2024-01-02,a,1.5\n2024-01-03,b,2\n")
    df = csv_scan(spark, p)
    assert dict(df.dtypes)["run_date"] == "date"
    assert categorical_columns(df.schema, source="csv") == ["run_date", "account"]
    assert categorical_columns(df.schema) == ["account"]
    assert numeric_columns(df.schema) == ["cost"]


def test_csv_landing_to_silver_equals_typed_path(spark):
    from pyspark.sql import functions as F

    from fleetlake.operators.bronze import build_bronze
    from fleetlake.operators.silver import score_silver
    from fleetlake.session import scratch_path
    from fleetlake.sources.files import write_csv
    from fleetlake.sources.telemetry import load_telemetry
    from tests.conftest import SF_SMALL

    tel = load_telemetry(spark, SF_SMALL)
    path = scratch_path(spark, "raw") + "/events.csv"
    write_csv(tel.withColumn("event_ts", F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm")), path)
    raw = csv_scan(spark, path)  # inferred types, as for an uploaded file
    cols = ["job_id", "event_ts", "partition_date", "reliability_score", "severity", "customer_summary"]
    via_csv = score_silver(build_bronze(raw)).select(*cols)
    direct = score_silver(build_bronze(tel)).select(*cols)
    assert sorted(map(tuple, via_csv.collect())) == sorted(map(tuple, direct.collect()))


def test_csv_keeps_line_breaks_quotes_and_padded_numbers(spark):
    from fleetlake.sources.files import csv_rejects

    path = scratch_path(spark, "csv-text") + "/t.csv"
    rows = [(1, 'two\nlines, "quoted"', " 1.5"), (2, " padded text ", "2"), (3, "plain", "NA")]
    write_csv(spark.createDataFrame(rows, "i int, t string, x string"), path)
    back = csv_scan(spark, path, multi_line=True)
    assert dict(back.dtypes) == {"i": "bigint", "t": "string", "x": "double"}
    assert sorted(map(tuple, back.collect())) == [(1, rows[0][1], 1.5), (2, rows[1][1], 2.0), (3, "plain", None)]
    typed = csv_scan(spark, path, "i int, t string, x bigint", multi_line=True)
    assert sorted((r.i, r.x) for r in typed.collect()) == [(1, None), (2, 2), (3, None)]
    rejects = {r.column: r.rejected for r in csv_rejects(spark, path, "i int, t string, x bigint", True).collect()}
    assert rejects == {"i": 0, "t": 0, "x": 1}


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    import fleetlake.session as session

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Context:
        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
