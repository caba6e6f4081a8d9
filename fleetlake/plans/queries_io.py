"""Sources, sinks, run logs and streaming queries (A, H, K).

Queries that write go to a fresh folder under the cluster's shared
checkpoint folder and return the rows read back, so SQL over the source
tables is their oracle.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlake.functions.exprs import iso_seconds
from fleetlake.operators.incidents import build_incident_queue, incident_candidates
from fleetlake.operators.keyed import read_rows, upsert_rows
from fleetlake.operators.runlog import (
    PROFILE_HEAD_SCHEMA,
    append_runs,
    decode_summary,
    decode_variant,
    encode_summary,
    load_session,
    recent_runs,
    session_list,
)
from fleetlake.operators.silver import score_silver
from fleetlake.plans import oracle as o
from fleetlake.plans.catalog import register
from fleetlake.plans.medallion import run_feature_pipeline
from fleetlake.plans.published import published
from fleetlake.plans.queries_medallion import HEALTH_COLUMNS
from fleetlake.plans.queries_serving import QUEUE_COLS
from fleetlake.plans.timeline import add_runs
from fleetlake.plans.uploads import PROFILE_SCHEMA, analyse_session, analysis_runs, stored_sessions, upload_dataset
from fleetlake.session import scratch_path
from fleetlake.sources.files import (
    csv_scan,
    land_bronze,
    read_dataset,
    read_parquet_dataset,
    write_csv,
    write_parquet_dataset,
)
from fleetlake.sources.records import records_json
from fleetlake.sources.telemetry import TELEMETRY_SCHEMA, load_telemetry, read_tables
from fleetlake.streaming.refresh import QUEUE, latest_gold, run_gold_stream, run_silver_stream


@register("csv_scan", "SELECT * FROM events")
def q_csv_scan(spark, sf_dir):
    (events,) = read_tables(spark, sf_dir, "events")
    path = scratch_path(spark, "csv") + "/events.csv"
    write_csv(events, path)
    return csv_scan(spark, path)


def _text_roundtrip(spark, sf_dir, table: str):
    """A table whose texts hold line breaks and quotes, through CSV and back."""
    (df,) = read_tables(spark, sf_dir, table)
    path = scratch_path(spark, "csv") + f"/{table}.csv"
    write_csv(df, path)
    return csv_scan(spark, path, df.schema)


@register("csv_scan_documents", "SELECT * FROM documents")
def q_csv_scan_documents(spark, sf_dir):
    return _text_roundtrip(spark, sf_dir, "documents")


@register("csv_scan_pages", "SELECT * FROM pages")
def q_csv_scan_pages(spark, sf_dir):
    return _text_roundtrip(spark, sf_dir, "pages")


@register("read_dataset", "SELECT event_id, user_id, event_type, value FROM events")
def q_read_dataset(spark, sf_dir):
    """The reader is chosen by the extension."""
    (events,) = read_tables(spark, sf_dir, "events")
    path = scratch_path(spark, "json") + "/events.json"
    events.select("event_id", "user_id", "event_type", "value").write.json(path)
    return read_dataset(spark, path, "event_id bigint, user_id bigint, event_type string, value double")


@register("parquet_roundtrip", o.with_ctes(o.TELEMETRY, body="SELECT * FROM telemetry"))
def q_parquet_roundtrip(spark, sf_dir):
    tel = load_telemetry(spark, sf_dir)
    path = scratch_path(spark, "parquet") + "/telemetry"
    write_parquet_dataset(tel, path, ["status", "account_tier"], cluster_by=["event_ts", "job_id"])
    back = read_parquet_dataset(spark, path, TELEMETRY_SCHEMA)
    return back.select(*[f.name for f in TELEMETRY_SCHEMA.fields])


@register("bronze_land", "SELECT * FROM events")
def q_bronze_land(spark, sf_dir):
    (events,) = read_tables(spark, sf_dir, "events")
    landed = land_bronze(events, scratch_path(spark, "bronze") + "/events")
    return landed.drop("_ingested_at")


_REC_SQL = (
    "json_object('incident_id', incident_id, 'job_id', job_id, 'customer_id', customer_id, "
    "'customer_name', customer_name, 'workload_name', workload_name, "
    "'event_ts', strftime(event_ts, '%Y-%m-%dT%H:%M:%S'), 'severity', severity, 'severity_rank', severity_rank, "
    "'reliability_score', reliability_score, 'needs_customer_update', needs_customer_update, "
    "'summary_line', summary_line)::VARCHAR"
)


@register("records_json", o.incidents_sql(f"SELECT {_REC_SQL} AS record FROM queue"))
def q_records_json(spark, sf_dir):
    queue = published(spark, sf_dir, "incident_queue")
    return records_json(queue.select(*[c.strip() for c in QUEUE_COLS.split(",")]))


@register(
    "pipeline_manifest",
    o.incidents_sql(
        "SELECT (SELECT count(*) FROM telemetry) AS raw_rows, (SELECT count(*) FROM silver) AS feature_rows, "
        "(SELECT count(*) FROM queue) AS incident_count, (SELECT count(*) FROM customer_health) AS customer_count"
    ),
)
def q_pipeline_manifest(spark, sf_dir):
    m = run_feature_pipeline(spark, load_telemetry(spark, sf_dir), scratch_path(spark, "lake"))
    return m.select("raw_rows", "feature_rows", "incident_count", "customer_count")


# ---- run log: the events table replayed as status updates onto user ids ---------------------


def _updates(spark, sf_dir):
    (events,) = read_tables(spark, sf_dir, "events")
    return events.select(
        F.col("user_id").cast("string").alias("id"),
        F.col("event_type").alias("status"),
        iso_seconds("ts").alias("started_at"),
        F.lit(None).cast("string").alias("finished_at"),
        F.col("props").alias("summary_json"),
        F.lit(None).cast("string").alias("error_text"),
        F.col("event_id").alias("_seq"),
    )


RUNLOG_SCHEMA = (
    "id string, status string, started_at string, finished_at string, summary_json string, error_text string, "
    "_seq bigint"
)


def _runlog(spark, sf_dir):
    """Two upserts: every second event first, then the rest, which replaces rows and adds new ids."""
    updates, table = _updates(spark, sf_dir), scratch_path(spark, "runlog")
    first = F.col("_seq") % 2 == 0
    upsert_rows(spark, table, updates.filter(first), RUNLOG_SCHEMA)
    upsert_rows(spark, table, updates.filter(~first), RUNLOG_SCHEMA)
    return read_rows(spark, table, RUNLOG_SCHEMA)


_LATEST_SQL = """latest AS (
  SELECT CAST(user_id AS VARCHAR) AS id, event_type AS status, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS started_at,
    CAST(NULL AS VARCHAR) AS finished_at, props AS summary_json, CAST(NULL AS VARCHAR) AS error_text, event_id AS _seq
  FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1
)"""


@register("runlog_upsert", o.with_ctes(_LATEST_SQL, body="SELECT * FROM latest"))
def q_runlog_upsert(spark, sf_dir):
    return _runlog(spark, sf_dir)


@register(
    "runlog_recent",
    o.with_ctes(_LATEST_SQL, body="SELECT * FROM latest ORDER BY started_at DESC NULLS LAST, id LIMIT 6"),
)
def q_runlog_recent(spark, sf_dir):
    return recent_runs(_runlog(spark, sf_dir))


@register(
    "runlog_decode",
    o.with_ctes(
        _LATEST_SQL,
        body="SELECT id, status, CAST(json_extract(summary_json, '$.k') AS INTEGER) AS k FROM latest",
    ),
)
def q_runlog_decode(spark, sf_dir):
    decoded = decode_summary(_runlog(spark, sf_dir), "k INT")
    return decoded.select("id", "status", F.col("summary.k").alias("k"))


@register(
    "runlog_variant",
    o.with_ctes(
        _LATEST_SQL,
        body="SELECT id, status, CAST(json_extract(summary_json, '$.k') AS INTEGER) AS k, "
        "CAST(json_extract(summary_json, '$.absent') AS INTEGER) AS absent FROM latest",
    ),
)
def q_runlog_variant(spark, sf_dir):
    """H4 without a caller's schema: fields are read by path, absent ones are null."""
    decoded = decode_variant(_runlog(spark, sf_dir))
    k, absent = (F.try_variant_get("summary", f"$.{f}", "int").alias(f) for f in ("k", "absent"))
    return decoded.select("id", "status", k, absent)


@register(
    "runlog_encode",
    "SELECT CAST(event_id AS VARCHAR) AS id, json_object('event_type', event_type, 'value', value, "
    "'user_id', user_id)::VARCHAR AS summary_json FROM events",
)
def q_runlog_encode(spark, sf_dir):
    (events,) = read_tables(spark, sf_dir, "events")
    return events.select(
        F.col("event_id").cast("string").alias("id"),
        encode_summary(
            {"event_type": F.col("event_type"), "value": F.col("value"), "user_id": F.col("user_id")}
        ).alias("summary_json"),
    )


_SESSIONS_SQL = """sessions AS (
  SELECT 'session-' || CAST(user_id AS VARCHAR) AS id, 'user-' || CAST(user_id AS VARCHAR) || '.csv' AS filename,
    max(ts) AS created_at, count(*) AS n, count(DISTINCT event_type) AS k
  FROM events GROUP BY user_id
)"""


@register(
    "session_list",
    o.with_ctes(
        _SESSIONS_SQL,
        body="SELECT id, filename, created_at, n AS rows, CAST(k AS INTEGER) AS columns, "
        "'event_type,value' AS column_names FROM sessions ORDER BY created_at DESC NULLS LAST, id LIMIT 25",
    ),
)
def q_session_list(spark, sf_dir):
    out = session_list(_sessions(spark, sf_dir))
    return out.withColumn("column_names", F.array_join("column_names", ","))


# ---- streaming -------------------------------------------------------------------------------


#: Micro-batches of the streaming queries, whatever the number of files.
EPOCHS = 4


def _stage_source(spark, sf_dir) -> tuple[str, int]:
    """Land telemetry in time order as files, as if they arrived in turn; returns how many to take at a time."""
    src = scratch_path(spark, "stream-src")
    load_telemetry(spark, sf_dir).repartitionByRange("event_ts", "job_id").write.parquet(src)
    files = len(spark.read.schema(TELEMETRY_SCHEMA).parquet(src).inputFiles())
    return src, max(1, -(-files // EPOCHS))


_STREAM_SILVER_COLS = (
    "job_id, customer_id, event_ts, latency_over_sla_min, memory_pressure_score, queue_pressure_score, "
    "shuffle_pressure_score, reliability_score, severity, severity_rank, root_cause_guess, customer_summary"
)


@register("stream_silver", o.silver_sql(f"SELECT {_STREAM_SILVER_COLS} FROM silver"))
def q_stream_silver(spark, sf_dir):
    src, files = _stage_source(spark, sf_dir)
    out, ckpt = scratch_path(spark, "stream-silver"), scratch_path(spark, "stream-ckpt")
    run_silver_stream(spark, src, TELEMETRY_SCHEMA, out, ckpt, files_per_trigger=files)
    return spark.read.parquet(out).select(*[c.strip() for c in _STREAM_SILVER_COLS.split(",")])


def _gold_stream(spark, sf_dir) -> str:
    src, files = _stage_source(spark, sf_dir)
    silver, gold, ckpt = (scratch_path(spark, t) for t in ("sg-silver", "sg-gold", "sg-ckpt"))
    run_gold_stream(spark, src, TELEMETRY_SCHEMA, silver, gold, ckpt, days=7, files_per_trigger=files)
    return gold


_STREAM_QUEUE_COLS = "job_id, customer_id, event_ts, severity, severity_rank, needs_customer_update, summary_line"


@register(
    "stream_incidents",
    o.incidents_sql(
        f"SELECT {_STREAM_QUEUE_COLS} FROM incidents "
        "ORDER BY severity_rank NULLS LAST, event_ts DESC NULLS LAST, job_id NULLS LAST LIMIT 16"
    ),
)
def q_stream_incidents(spark, sf_dir):
    queue = latest_gold(spark, _gold_stream(spark, sf_dir), QUEUE)
    return queue.select(*[c.strip() for c in _STREAM_QUEUE_COLS.split(",")])


@register("stream_gold", o.health_sql(7, f"SELECT {HEALTH_COLUMNS} FROM customer_health"))
def q_stream_gold(spark, sf_dir):
    return latest_gold(spark, _gold_stream(spark, sf_dir)).select(*[c.strip() for c in HEALTH_COLUMNS.split(",")])


# ---- the timeline: runs that arrive late, numbered and summed by period ----------------------


def _timeline(spark, sf_dir):
    """A fifth of the runs arrives after the others."""
    raw = scratch_path(spark, "timeline-src")
    load_telemetry(spark, sf_dir).write.parquet(raw)
    silver = score_silver(spark.read.schema(TELEMETRY_SCHEMA).parquet(raw))
    late, base = F.pmod(F.xxhash64("job_id"), F.lit(5)) == 0, scratch_path(spark, "timeline")
    add_runs(spark, base, silver.filter(~late), grain="month")
    return add_runs(spark, base, silver.filter(late), grain="month")


@register("timeline_incident_ids", o.silver_sql("SELECT job_id, event_ts, incident_id FROM silver"))
def q_timeline_incident_ids(spark, sf_dir):
    return _timeline(spark, sf_dir).silver().select("job_id", "event_ts", "incident_id")


@register(
    "timeline_lookup",
    o.incidents_sql(f"SELECT {QUEUE_COLS} FROM incidents ORDER BY {o.QUEUE_ORDER} LIMIT 1"),
)
def q_timeline_lookup(spark, sf_dir):
    line = _timeline(spark, sf_dir)
    # the id only, so that the columns of no use here are not read
    wanted = build_incident_queue(line.silver(), 1).select("incident_id").first()  # one row
    found = incident_candidates(line.incident(wanted["incident_id"] if wanted else ""))
    return found.select(*[c.strip() for c in QUEUE_COLS.split(",")])


@register("timeline_health", o.health_sql(7, f"SELECT {HEALTH_COLUMNS} FROM customer_health"))
def q_timeline_health(spark, sf_dir):
    return _timeline(spark, sf_dir).health(7).select(*[c.strip() for c in HEALTH_COLUMNS.split(",")])


@register("timeline_health_90d", o.health_sql(90, f"SELECT {HEALTH_COLUMNS} FROM customer_health"))
def q_timeline_health_90d(spark, sf_dir):
    return _timeline(spark, sf_dir).health(90).select(*[c.strip() for c in HEALTH_COLUMNS.split(",")])


# ---- sessions and appended runs ------------------------------------------------------------


def _sessions(spark, sf_dir):
    (events,) = read_tables(spark, sf_dir, "events")
    grouped = events.groupBy("user_id").agg(
        F.max("ts").alias("created_at"),
        F.to_json(
            F.struct(
                F.count(F.lit(1)).alias("rows"),
                F.count_distinct("event_type").cast("int").alias("columns"),
                F.array(F.lit("event_type"), F.lit("value")).alias("column_names"),
            )
        ).alias("profile_json"),
    )
    return grouped.select(
        F.concat(F.lit("session-"), F.col("user_id").cast("string")).alias("id"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string"), F.lit(".csv")).alias("filename"),
        "profile_json",
        "created_at",
    )


@register(
    "session_lookup",
    o.with_ctes(
        _SESSIONS_SQL,
        body="SELECT id, filename, created_at, n AS rows, 'event_type,value' AS column_names FROM sessions WHERE id = "
        "(SELECT id FROM sessions ORDER BY created_at DESC NULLS LAST, id LIMIT 1)",
    ),
)
def q_session_lookup(spark, sf_dir):
    sessions = _sessions(spark, sf_dir)
    newest = sessions.orderBy(F.col("created_at").desc_nulls_last(), "id").limit(1).select("id").scalar()
    found = load_session(sessions, newest, PROFILE_HEAD_SCHEMA)
    return found.select(
        "id",
        "filename",
        "created_at",
        F.col("profile.rows").alias("rows"),
        F.array_join("profile.column_names", ",").alias("column_names"),
    )


@register(
    "upload_session",
    "SELECT 'events.csv' AS filename, 'csv' AS source, count(*) AS rows, 4 AS columns, "
    "'event_id,user_id,event_type,value' AS column_names, 'event_type' AS categorical, "
    "count(*) FILTER (WHERE value IS NULL) AS missing_values, 2 AS uploads FROM events",
)
def q_upload_session(spark, sf_dir):
    """H5: the file is uploaded twice under one id; the session is replaced, both landings stay readable."""
    (events,) = read_tables(spark, sf_dir, "events")
    base = scratch_path(spark, "uploads")
    path = f"{base}/in/events.csv"
    write_csv(events.select("event_id", "user_id", "event_type", "value"), path)
    first = upload_dataset(spark, path, base, "s", order_by=["event_id"]).first()  # one row
    second = upload_dataset(spark, path, base, "s", order_by=["event_id"])
    profile = F.from_json("profile_json", PROFILE_SCHEMA)
    old = spark.read.parquet(first["bronze_path"]).groupBy().agg(F.count(F.lit(1)).alias("n")).scalar()
    sessions = stored_sessions(spark, base).withColumn("profile", profile)
    kept = second.select("bronze_path").scalar() != F.lit(first["bronze_path"])
    return sessions.select(
        "filename",
        "source",
        F.col("profile.rows").alias("rows"),
        F.col("profile.columns").alias("columns"),
        F.array_join("profile.column_names", ",").alias("column_names"),
        F.array_join("profile.categorical_columns", ",").alias("categorical"),
        F.col("profile.missing_values")["value"].alias("missing_values"),
        F.when(kept & (old == F.col("profile.rows")), 2).otherwise(1).alias("uploads"),
    )


@register(
    "upload_answer",
    "SELECT event_type, count(value) AS runs, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max "
    "FROM events WHERE event_type IS NOT NULL GROUP BY event_type ORDER BY mean DESC LIMIT 10",
)
def q_upload_answer(spark, sf_dir):
    """A question to an uploaded file: the answer's rows as the analysis log keeps them."""
    (events,) = read_tables(spark, sf_dir, "events")
    base = scratch_path(spark, "uploads")
    path = f"{base}/in/events.csv"
    write_csv(events.select("event_type", "value"), path)
    upload_dataset(spark, path, base, "s")
    analyse_session(spark, base, "s", "Compare value by event type")
    answer = "array<struct<event_type:string,count:bigint,mean:double,min:double,max:double>>"
    rows = analysis_runs(spark, base).select(F.explode(F.from_json("result_json", answer)).alias("r")).select("r.*")
    return rows.select("event_type", F.col("count").alias("runs"), F.round("mean", 6).alias("mean"), "min", "max")


@register(
    "runlog_append",
    "SELECT CAST(user_id AS VARCHAR) AS session_id, event_type AS query, props AS result_json, "
    "ts AS created_at FROM events",
)
def q_runlog_append(spark, sf_dir):
    (events,) = read_tables(spark, sf_dir, "events")
    runs = events.select(
        F.col("user_id").cast("string").alias("session_id"),
        F.col("event_type").alias("query"),
        F.col("props").alias("result_json"),
        F.col("ts").alias("created_at"),
    )
    path = scratch_path(spark, "runs") + "/analysis_runs"
    append_runs(runs.filter(F.col("session_id") < "5"), path)
    append_runs(runs.filter(F.coalesce(F.col("session_id") >= "5", F.lit(True))), path)
    return spark.read.parquet(path)
