import datetime as dt

from pyspark.sql import functions as F

from fleetlake.operators.dashboard import activity_feed, comparable_incidents, overview
from fleetlake.operators.health import build_customer_health
from fleetlake.operators.incidents import build_incident_queue, incident_candidates
from fleetlake.operators.runlog import load_session, session_list
from fleetlake.operators.silver import build_silver, score_silver
from fleetlake.session import scratch_path
from fleetlake.sources.files import read_dataset, write_csv
from tests.test_silver import rows


def test_overview_on_empty_tables(spark):
    silver = score_silver(rows(spark, {})).limit(0)
    health = build_customer_health(silver, 7)
    queue = build_incident_queue(silver.withColumn("incident_id", F.col("job_id")))
    r = overview(health, queue, silver).first()
    assert (r.customer_count, r.average_health_score, r.jobs_last_7d, r.high_priority_incidents) == (0, 0.0, 0, 0)
    assert r.latest_event_at is None


def test_queue_order_and_flags(spark):
    t = dt.datetime(2024, 4, 24, 9, 0)
    df = rows(
        spark,
        dict(event_ts=t, status="failed", failure_category="executor_oom"),
        dict(event_ts=t + dt.timedelta(hours=1), status="failed", failure_category="executor_oom"),
        dict(event_ts=t + dt.timedelta(hours=2), status="degraded", failure_category="hot_partition"),
        dict(event_ts=t + dt.timedelta(hours=3)),  # healthy: not an incident
    )
    silver = build_silver(df)
    q = build_incident_queue(silver).collect()
    assert [r.severity for r in q] == ["high", "high", "medium"]
    assert q[0].event_ts > q[1].event_ts  # newest first within a severity
    assert [r.needs_customer_update for r in q] == [True, True, False]
    assert q[0].summary_line.startswith("executor oom on meter-forecast for Meridian Energy with reliability ")
    cands = incident_candidates(silver)
    comp = comparable_incidents(cands, "executor_oom", q[0].incident_id).collect()
    assert [c.incident_id for c in comp] == [q[1].incident_id]


def test_activity_feed_newest_first(spark):
    ev = spark.createDataFrame(
        [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i % 50), "view") for i in range(100)],
        "event_id bigint, ts timestamp_ntz, event_type string",
    )
    got = activity_feed(ev, 5).collect()
    assert [r.event_id for r in got] == [99, 49, 98, 48, 97]


def test_session_list_and_lookup(spark):
    s = spark.createDataFrame(
        [
            ("s1", "a.csv", '{"rows": 3, "columns": 2, "column_names": ["x", "y"]}', dt.datetime(2024, 1, 2)),
            ("s2", "b.csv", "{}", dt.datetime(2024, 1, 3)),
        ],
        "id string, filename string, profile_json string, created_at timestamp_ntz",
    )
    lst = session_list(s).collect()
    assert [r.id for r in lst] == ["s2", "s1"]
    assert lst[0].rows is None and lst[0].column_names == [] and lst[1].column_names == ["x", "y"]
    assert load_session(s, "s1").count() == 1 and load_session(s, "nope").count() == 0


def test_csv_round_trip_by_extension(spark):
    df = spark.createDataFrame(
        [(1, "a,b", 1.5, True, dt.datetime(2024, 1, 1, 0, 0, 1, 5)), (2, 'say "hi"', None, False, None)],
        "id bigint, s string, x double, f boolean, ts timestamp_ntz",
    )
    path = scratch_path(spark, "csvrt") + "/data.csv"
    write_csv(df, path)
    back = read_dataset(spark, path)
    assert dict(back.dtypes) == dict(df.dtypes)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_golden_dashboard_incident_texts(spark):
    # one incident of the published dashboard snapshot (FIXTURES A4); the metric
    # inputs are chosen to reproduce its scores (reliability 28.0, pressures 35.0 / 35.2)
    df = rows(
        spark,
        dict(
            customer_id="meridian-energy",
            customer_name="Meridian Energy",
            workload_name="load_forecast_training",
            event_ts=dt.datetime(2026, 4, 24, 3, 27),
            status="degraded",
            failure_category="skewed_shuffle",
            duration_min=75,
            sla_minutes=60,
            queue_depth=7,
            memory_utilization_pct=78,
            spill_gb=16.0,
            failed_tasks=20,
            retried_tasks=25,
        ),
    )
    inc = build_incident_queue(build_silver(df)).first()
    assert (inc.reliability_score, inc.queue_pressure_score, inc.memory_pressure_score) == (28.0, 35.0, 35.2)
    assert inc.latency_over_sla_min == 15 and inc.severity == "high"
    assert inc.customer_summary == "Meridian Energy load_forecast_training is degraded because of skewed shuffle."
    assert inc.summary_line == "skewed shuffle on load_forecast_training for Meridian Energy with reliability 28.0."
    assert inc.recommended_action == (
        "Salt the skewed key, raise shuffle partitions, and backfill the worst partition range."
    )
    assert inc.incident_id == "inc-meridian-0424-0000"
