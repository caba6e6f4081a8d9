
from fleetlake.operators.runlog import PIPELINE_RUNS_SCHEMA, decode_summary, recent_runs, upsert
from fleetlake.operators.silver import score_silver
from fleetlake.session import scratch_path
from fleetlake.sources.telemetry import TELEMETRY_SCHEMA, load_telemetry
from fleetlake.streaming.refresh import run_silver_stream
from tests.conftest import SF_SMALL

COLS = [f.name for f in PIPELINE_RUNS_SCHEMA.fields] + ["_seq"]


def _runs(spark, rows):
    return spark.createDataFrame(rows, ",".join(f"{c} {'bigint' if c == '_seq' else 'string'}" for c in COLS))


def test_upsert_latest_wins_whole_row(spark):
    base = _runs(spark, [("p1", "running", "2024-01-01T00:00:00", None, None, None, 1)])
    upd = _runs(
        spark,
        [
            ("p1", "success", "2024-01-01T00:00:00", "2024-01-01T00:05:00", '{"rows": 3}', None, 2),
            ("p2", "failed", "2024-01-02T00:00:00", None, "", "boom", 3),
        ],
    )
    out = {r.id: r for r in upsert(base, upd).collect()}
    assert out["p1"].status == "success" and out["p1"].finished_at == "2024-01-01T00:05:00"
    # replaying the same updates changes nothing (idempotent)
    again = upsert(upsert(base, upd), upd)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, upsert(base, upd).collect()))
    dec = {r.id: r.summary for r in decode_summary(upsert(base, upd), "rows INT").collect()}
    assert dec["p1"].rows == 3 and dec["p2"] is None
    assert [r.id for r in recent_runs(upsert(base, upd), 1).collect()] == ["p2"]


def test_stream_silver_equals_batch(spark):
    tel = load_telemetry(spark, SF_SMALL)
    src = scratch_path(spark, "t-src")
    tel.repartition(3).write.parquet(src)
    out, ck = scratch_path(spark, "t-out"), scratch_path(spark, "t-ck")
    run_silver_stream(spark, src, TELEMETRY_SCHEMA, out, ck, files_per_trigger=1)
    cols = ["job_id", "reliability_score", "severity", "customer_summary"]
    streamed = sorted(map(tuple, spark.read.parquet(out).select(*cols).collect()))
    batch = sorted(map(tuple, score_silver(tel).select(*cols).collect()))
    assert streamed == batch
    # a second availableNow run over the same folder finds nothing new
    run_silver_stream(spark, src, TELEMETRY_SCHEMA, out, ck)
    assert spark.read.parquet(out).count() == tel.count()


def test_publish_upsert_versions(spark):
    from fleetlake.operators.runlog import publish_upsert, read_current

    schema = ",".join(f"{c} {'bigint' if c == '_seq' else 'string'}" for c in COLS)
    table = scratch_path(spark, "runlog")
    assert read_current(spark, table, schema).count() == 0
    v1 = publish_upsert(spark, table, _runs(spark, [("p1", "running", "t0", None, None, None, 1)]), schema)
    v2 = publish_upsert(spark, table, _runs(spark, [("p1", "success", "t0", "t1", "{}", None, 2)]), schema)
    assert (v1, v2) == (1, 2)
    cur = read_current(spark, table, schema).collect()
    assert [(r.id, r.status, r._seq) for r in cur] == [("p1", "success", 2)]
    # the first version is untouched
    old = spark.read.schema(schema).parquet(f"{table}/version=00000001").collect()
    assert [(r.status, r._seq) for r in old] == [("running", 1)]


def test_gold_stream_restart_equals_batch(spark):
    from pyspark.sql import functions as F

    from fleetlake.operators.health import build_customer_health
    from fleetlake.streaming.refresh import latest_gold, run_gold_stream

    tel = load_telemetry(spark, SF_SMALL)
    cut = tel.agg(F.percentile_approx(F.unix_micros(F.col("event_ts").cast("timestamp")), 0.5)).first()[0]
    early = tel.filter(F.unix_micros(F.col("event_ts").cast("timestamp")) <= cut)
    late = tel.filter(F.unix_micros(F.col("event_ts").cast("timestamp")) > cut)
    src = scratch_path(spark, "g-src")
    early.repartition(2).write.parquet(src)
    silver, gold, ck = scratch_path(spark, "g-silver"), scratch_path(spark, "g-gold"), scratch_path(spark, "g-ck")
    run_gold_stream(spark, src, TELEMETRY_SCHEMA, silver, gold, ck, days=90, files_per_trigger=1)
    late.repartition(2).write.mode("append").parquet(src)  # new files arrive; the query restarts
    run_gold_stream(spark, src, TELEMETRY_SCHEMA, silver, gold, ck, days=90, files_per_trigger=1)
    cols = ["customer_id", "jobs_last_7d", "customer_health_score", "at_risk_workload"]
    streamed = sorted(map(tuple, latest_gold(spark, gold).select(*cols).collect()))
    batch = sorted(map(tuple, build_customer_health(score_silver(tel), 90).select(*cols).collect()))
    assert streamed == batch


def test_gold_stream_with_late_files_reads_few_rows_again(spark):
    """Late runs fall into old panes; health equals the batch, and only its own last epochs stay."""
    import os

    from pyspark.sql import functions as F

    from fleetlake.operators.health import build_customer_health
    from fleetlake.streaming import refresh
    from fleetlake.streaming.refresh import latest_gold, run_gold_stream

    tel = load_telemetry(spark, SF_SMALL).filter("event_ts >= '1998-03-01'").cache()
    src = scratch_path(spark, "late-src")
    folders = [scratch_path(spark, t) for t in ("late-silver", "late-gold", "late-ck")]
    for part in range(3):  # each file spans the whole time
        tel.filter(F.pmod(F.hash("job_id"), F.lit(3)) == part).coalesce(1).write.mode("append").parquet(src)
        run_gold_stream(spark, src, TELEMETRY_SCHEMA, *folders, days=30, files_per_trigger=1)
    cols = ["customer_id", "jobs_last_7d", "avg_duration_min", "customer_health_score", "at_risk_workload", "dominant_failure"]
    streamed = sorted(map(tuple, latest_gold(spark, folders[1]).select(*cols).collect()))
    assert streamed == sorted(map(tuple, build_customer_health(score_silver(tel), 30).select(*cols).collect()))
    silver = folders[0].removeprefix("file:")
    assert all(name.startswith(("event_month=", "_", ".")) for name in os.listdir(silver))
    kept, refresh.KEPT_EPOCHS = refresh.KEPT_EPOCHS, 1
    try:
        tel.limit(1).coalesce(1).write.mode("append").parquet(src)
        run_gold_stream(spark, src, TELEMETRY_SCHEMA, *folders, days=30, files_per_trigger=1)
    finally:
        refresh.KEPT_EPOCHS = kept
    assert sorted(os.listdir(f"{folders[1].removeprefix('file:')}/customer_health"))[-1] == "epoch=3"
    assert "epoch=2" not in os.listdir(f"{folders[1].removeprefix('file:')}/customer_health")


def test_streamed_silver_can_be_read_from_a_time_on(spark):
    import datetime as dt

    from fleetlake.streaming.refresh import recent_silver, run_gold_stream

    tel = load_telemetry(spark, SF_SMALL).filter("event_ts >= '1998-05-01'")
    src, silver, gold, ck = (scratch_path(spark, t) for t in ("rs-src", "rs-silver", "rs-gold", "rs-ck"))
    tel.coalesce(1).write.parquet(src)
    run_gold_stream(spark, src, TELEMETRY_SCHEMA, silver, gold, ck, days=30)
    scored = score_silver(tel)
    found = recent_silver(spark, silver, scored.schema, dt.datetime(1998, 6, 10))
    assert found.count() == scored.filter("event_ts >= timestamp_ntz'1998-06-10 00:00:00'").count()


def test_gold_stream_writes_its_runs_once(spark, monkeypatch):
    """No copy of an epoch beside silver; runs without a time are in the queue only."""
    import os

    from pyspark.sql import functions as F

    from fleetlake.operators import position
    from fleetlake.streaming.refresh import QUEUE, latest_gold, run_gold_stream

    monkeypatch.setattr(position, "SORT_ROWS", 50)
    tel = load_telemetry(spark, SF_SMALL).filter("event_ts >= '1998-05-01'").cache()
    first = tel.agg(F.min("job_id")).first()[0]
    odd = tel.filter(F.col("job_id") == first)
    untimed = odd.withColumns(
        {"event_ts": F.lit(None).cast("timestamp_ntz"), "job_id": F.lit("job-untimed"), "status": F.lit("failed")}
    )
    src, silver, gold, ck = (scratch_path(spark, t) for t in ("once-src", "once-silver", "once-gold", "once-ck"))
    tel.unionByName(untimed).coalesce(1).write.parquet(src)
    run_gold_stream(spark, src, TELEMETRY_SCHEMA, silver, gold, ck, days=30)
    assert "_epoch" not in os.listdir(ck.removeprefix("file:"))
    stored = spark.read.parquet(silver)
    assert stored.count() == tel.count() and stored.filter("event_ts IS NULL").count() == 0
    cols = ["job_id", "reliability_score", "severity", "customer_summary"]
    assert sorted(map(str, stored.select(*cols).collect())) == sorted(map(str, score_silver(tel).select(*cols).collect()))
    # all high incidents with a time come before it, so the queue of none but such runs shows it
    only, gold2 = scratch_path(spark, "once-src2"), scratch_path(spark, "once-gold2")
    tel.filter("status = 'success'").limit(1).unionByName(untimed).coalesce(1).write.parquet(only)
    run_gold_stream(spark, only, TELEMETRY_SCHEMA, scratch_path(spark, "os"), gold2, scratch_path(spark, "oc"), days=30)
    assert "job-untimed" in [r.job_id for r in latest_gold(spark, gold2, QUEUE).collect()]
