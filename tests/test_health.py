import datetime as dt

from pyspark.sql import functions as F

from fleetlake.functions.exprs import exact_mean_tenths, r1
from fleetlake.operators.health import build_customer_health, recent_window, risk_band, worst_workload
from fleetlake.operators.silver import score_silver
from tests.test_silver import rows

T0 = dt.datetime(2024, 4, 24, 9, 0)


def test_window_keeps_event_exactly_days_before_latest(spark):
    df = score_silver(
        rows(
            spark,
            dict(event_ts=T0),
            dict(event_ts=T0 - dt.timedelta(days=7)),
            dict(event_ts=T0 - dt.timedelta(days=7, seconds=1)),
        )
    )
    assert recent_window(df, 7).count() == 2


def test_worst_workload_first_non_null_in_reliability_order(spark):
    df = score_silver(
        rows(
            spark,
            # worst reliability but null workload: the workload comes from the next row
            dict(workload_name=None, status="failed", failure_category="executor_oom"),
            dict(workload_name="w-degraded", status="degraded", failure_category="skewed_shuffle"),
            dict(workload_name="w-ok"),
            # null reliability sorts last
            dict(workload_name="w-null", queue_depth=None),
        )
    )
    out = worst_workload(df).first()
    assert out.at_risk_workload == "w-degraded"
    assert out.dominant_failure == "executor_oom"


def test_golden_dashboard_values(spark):
    df = spark.createDataFrame([(25.0,), (55.0,), (59.1,), (66.0,)], "s double")
    avg = df.agg(r1(exact_mean_tenths("s"))).first()[0]
    assert avg == 51.3
    bands = [r[0] for r in df.select(risk_band(F.col("s"))).collect()]
    assert bands == ["critical", "watch", "watch", "watch"]


def test_band_edges(spark):
    df = spark.createDataFrame([(44.9,), (45.0,), (71.9,), (72.0,), (None,)], "s double")
    assert [r[0] for r in df.select(risk_band(F.col("s"))).collect()] == [
        "critical",
        "watch",
        "watch",
        "healthy",
        "healthy",
    ]


def test_health_row_text(spark):
    df = score_silver(rows(spark, dict(), dict(status="failed", failure_category="hot_partition")))
    h = build_customer_health(df, 7).first()
    assert h.jobs_last_7d == 2 and h.failed_jobs == 1 and h.open_incidents == 1
    assert h.success_rate_pct == 50.0
    assert h.exec_summary == (
        f"Meridian Energy is trending {h.risk_band} with 1 high-severity incidents and 50.0% recent success."
    )


def test_health_independent_of_partition_count(spark):
    from fleetlake.sources.telemetry import load_telemetry
    from tests.conftest import SF_SMALL

    tel = load_telemetry(spark, SF_SMALL)
    outs = []
    for n in (1, 17):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        h = build_customer_health(score_silver(tel.repartition(n)), 90)
        outs.append(sorted(tuple(r) for r in h.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert outs[0] == outs[1]
