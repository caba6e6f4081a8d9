import datetime as dt

from pyspark.sql import functions as F

from fleetlake.operators.silver import build_silver, score_silver
from fleetlake.sources.telemetry import TELEMETRY_SCHEMA

BASE = dict(
    event_ts=dt.datetime(2024, 4, 24, 9, 13),
    partition_date="2024-04-24",
    customer_id="meridian-energy",
    customer_name="Meridian Energy",
    region="us-east",
    account_tier="strategic",
    cluster_name="c1",
    workload_name="meter-forecast",
    job_id="job-1",
    sla_minutes=60,
    status="success",
    failure_category="none",
    user_impact=None,
    ticket_hint=None,
    shuffle_gb=10.0,
    input_rows_m=20,
    spill_gb=0.0,
    memory_utilization_pct=60,
    queue_depth=0,
    failed_tasks=0,
    retried_tasks=0,
    duration_min=50,
    cost_cents=100,
)


def rows(spark, *overrides):
    data = []
    for i, o in enumerate(overrides):
        r = dict(BASE, job_id=f"job-{i:05d}")
        r.update(o)
        data.append(tuple(r[f.name] for f in TELEMETRY_SCHEMA.fields))
    return spark.createDataFrame(data, TELEMETRY_SCHEMA)


def test_scores_on_known_rows(spark):
    df = rows(spark, {}, dict(queue_depth=7), dict(queue_depth=20), dict(queue_depth=8))
    got = score_silver(df).orderBy("job_id").select("queue_pressure_score").collect()
    assert [r[0] for r in got] == [0.0, 35.0, 100.0, 40.0]


def test_null_metric_gives_null_scores_not_zero(spark):
    df = rows(spark, dict(spill_gb=None), dict(queue_depth=None))
    out = score_silver(df).orderBy("job_id").collect()
    assert out[0].memory_pressure_score is None and out[0].reliability_score is None
    assert out[1].queue_pressure_score is None and out[1].reliability_score is None


def test_zero_input_rows_is_infinite_pressure(spark):
    out = score_silver(rows(spark, dict(input_rows_m=0), dict(input_rows_m=0, shuffle_gb=0.0))).orderBy("job_id")
    got = [r[0] for r in out.select("shuffle_pressure_score").collect()]
    assert got == [float("inf"), None]


def test_unknown_status_and_category(spark):
    out = score_silver(rows(spark, dict(status="weird", failure_category="mystery"))).first()
    assert out.root_cause_guess is None and out.recommended_action is None
    assert out.customer_summary == "Meridian Energy meter-forecast is weird because of mystery."
    assert out.severity_rank == 2  # 'weird' adds no penalty and is neither failed nor degraded


def test_severity_thresholds_exact(spark):
    # latency exactly 40 -> not high (> 40); exactly 15 -> not medium (> 15); queue 14 -> not high
    df = rows(
        spark,
        dict(duration_min=100, sla_minutes=60, memory_utilization_pct=0),  # latency 40
        dict(duration_min=75, sla_minutes=60, memory_utilization_pct=0),  # latency 15
        dict(queue_depth=14),
        dict(queue_depth=15),
        dict(status="failed"),
        dict(status="degraded"),
    )
    sev = [r[0] for r in score_silver(df).orderBy("job_id").select("severity").collect()]
    # row 0: latency 40 -> penalty 26 -> reliability 74 -> medium via latency > 15
    assert sev[0] == "medium"
    assert sev[1] == "low"
    assert sev[2] == "low"  # queue 14: penalty 15.4, reliability 84.6
    assert sev[3] == "high"
    assert sev[4] == "high"
    assert sev[5] == "medium"


def test_incident_ids_ties_and_width(spark):
    n = 10_050
    t0 = F.lit(dt.datetime(2024, 4, 24, 9, 0)).cast("timestamp_ntz")
    lits = {
        f.name: F.lit(BASE[f.name]).cast(f.dataType)
        for f in TELEMETRY_SCHEMA.fields
        if f.name not in ("job_id", "event_ts")
    }
    big = spark.range(n).select(
        # every 3rd row shares one timestamp (a hot key): ties broken by job_id
        F.when(F.col("id") % 3 == 0, t0)
        .otherwise(t0 + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("id").cast("decimal(18,6)")))
        .alias("event_ts"),
        F.format_string("job-%06d", F.col("id")).alias("job_id"),
        *[c.alias(k) for k, c in lits.items()],
    )
    ids = build_silver(big, num_partitions=7).select("job_id", "event_ts", "incident_id")
    got = sorted((r.event_ts, r.job_id, r.incident_id) for r in ids.collect())
    assert len({g[2] for g in got}) == n
    for pos, (_, _, iid) in enumerate(got):
        assert iid == f"inc-meridian-0424-{pos:04d}"
    assert got[-1][2].endswith("-10049")


def test_bronze_turns_nan_into_null(spark):
    from fleetlake.operators.bronze import build_bronze

    out = score_silver(build_bronze(rows(spark, dict(spill_gb=float("nan"))))).first()
    assert out.spill_gb is None and out.reliability_score is None and out.severity == "low"
