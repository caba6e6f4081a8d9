"""Plan-shape checks: the optimizer does what the design relies on."""

import re

from fleetlake.plans.catalog import queries
from tests.conftest import SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_udf_in_any_query(spark):
    skip = {"csv_scan", "parquet_roundtrip", "bronze_land", "pipeline_manifest", "stream_silver", "stream_gold", "stream_incidents"}
    for name, fn in queries().items():
        if name in skip:
            continue
        p = fn(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert "PythonUDF" not in p and "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name


def test_top_k_is_take_ordered(spark):
    p = plan(queries()["incident_queue"](spark, SF_SMALL))
    assert "TakeOrderedAndProject" in p


def test_lookup_filter_reaches_the_scan(spark):
    from fleetlake.operators.dashboard import load_incident

    # a stand-in incident table: the lookup column is renamed, the filter still
    # reaches the scan under the stored column name
    df = spark.read.parquet(f"{SF_SMALL}/events.parquet").withColumnRenamed("event_type", "incident_id")
    p = plan(load_incident(df, "click").select("event_id"))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,click)]" in p


def test_profile_is_one_scan(spark):
    df = queries()["column_features"](spark, SF_SMALL)
    assert plan(df).count("FileScan parquet") == 1


def test_column_pruning_in_activity_feed(spark):
    p = plan(queries()["activity_feed"](spark, SF_SMALL))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,event_type:string>" in p


def test_comparables_use_window_group_limit(spark):
    from fleetlake.operators.incidents import incident_candidates
    from fleetlake.operators.silver import score_silver
    from fleetlake.operators.triage import comparables_by_category, runbook_dimension
    from fleetlake.sources.telemetry import load_telemetry
    from pyspark.sql import functions as F

    pool = incident_candidates(
        score_silver(load_telemetry(spark, SF_SMALL)).withColumn("incident_id", F.col("job_id"))
    )
    p = plan(comparables_by_category(pool, runbook_dimension(spark)))
    assert "WindowGroupLimit" in p


def test_incident_ids_use_no_global_window(spark):
    p = plan(queries()["incident_ids"](spark, SF_SMALL))
    assert "row_number" not in p.lower() and "SinglePartition" not in p.split("BroadcastExchange")[0]


def test_literal_window_cutoff_reaches_the_scan(spark):
    from pyspark.sql import functions as F

    from fleetlake.operators.health import build_customer_health
    from fleetlake.operators.silver import score_silver
    from fleetlake.session import scratch_path
    from fleetlake.sources.files import write_parquet_dataset
    from fleetlake.sources.telemetry import load_telemetry

    path = scratch_path(spark, "push")
    write_parquet_dataset(score_silver(load_telemetry(spark, SF_SMALL)), path, ["severity"], ["event_ts", "job_id"])
    silver = spark.read.parquet(path)
    latest = silver.agg(F.max("event_ts")).first()[0]
    p = plan(build_customer_health(silver, 7, latest=latest))
    assert "GreaterThanOrEqual(event_ts," in p


def test_customer_health_reads_each_table_once_for_its_aggregates(spark):
    """One pass over the runs; the only further read is the latest event's subquery over orders."""
    df = queries()["customer_health"](spark, SF_SMALL)
    p = plan(df)
    assert len(set(re.findall(r"FileScan parquet \[(l_orderkey#\d+)", p))) == 1
    assert len(set(re.findall(r"FileScan parquet \[(o_orderkey#\d+)", p))) == 2


def test_streamed_silver_is_pruned_by_date(spark):
    import datetime as dt

    from fleetlake.operators.silver import score_silver
    from fleetlake.session import scratch_path
    from fleetlake.sources.telemetry import load_telemetry
    from fleetlake.streaming.refresh import recent_silver

    silver, path = score_silver(load_telemetry(spark, SF_SMALL)), scratch_path(spark, "dated")
    by_month = silver.selectExpr("*", "trunc(event_ts, 'month') AS event_month")
    by_month.write.partitionBy("event_month").parquet(path + "/batch=0")
    df = recent_silver(spark, path, silver.schema, dt.datetime(1998, 7, 1, 5))
    assert re.search(r"PartitionFilters: \[[^\]]*event_month#\d+ >= 1998-07-01", plan(df))
    assert df.count() == silver.filter("event_ts >= timestamp_ntz'1998-07-01 05:00:00'").count()
