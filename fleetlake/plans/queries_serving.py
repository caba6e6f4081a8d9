"""Incident queue, dashboard lookups and triage queries (E, F, G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlake.operators import dashboard as dash
from fleetlake.operators.health import build_customer_health, by_score
from fleetlake.operators.incidents import build_incident_queue, incident_candidates, top_incidents
from fleetlake.operators.runlog import recent_runs
from fleetlake.operators.triage import build_triage, runbook_dimension, triage_context, triage_rejects
from fleetlake.plans import oracle as o
from fleetlake.plans.catalog import register
from fleetlake.plans.medallion import agent_runs, current_table, last_refresh, pipeline_runs, run_triage
from fleetlake.plans.published import published, published_lake
from fleetlake.sources.telemetry import read_tables

QUEUE_COLS = (
    "incident_id, job_id, customer_id, customer_name, workload_name, event_ts, severity, severity_rank, "
    "reliability_score, needs_customer_update, summary_line"
)
_qc = [c.strip() for c in QUEUE_COLS.split(",")]


def gold(spark, sf_dir):
    """Published silver (with ids), all incidents, and health of the same refresh."""
    return tuple(published(spark, sf_dir, t) for t in ("silver", "incidents", "customer_health"))


@register(
    "incident_filter", o.incidents_sql("SELECT incident_id, job_id, severity, status, needs_customer_update FROM incidents")
)
def q_incident_filter(spark, sf_dir):
    silver = published(spark, sf_dir, "silver")
    return incident_candidates(silver).select("incident_id", "job_id", "severity", "status", "needs_customer_update")


@register("incident_queue", o.incidents_sql(f"SELECT {QUEUE_COLS} FROM queue"))
def q_incident_queue(spark, sf_dir):
    return build_incident_queue(published(spark, sf_dir, "silver")).select(*_qc)


@register(
    "dashboard_overview",
    o.incidents_sql(
        f"""SELECT count(*) AS customer_count,
  coalesce({o.r1(o.mean_tenths('customer_health_score'))}, 0e0) AS average_health_score,
  CAST(coalesce(sum(jobs_last_7d), 0) AS BIGINT) AS jobs_last_7d,
  CAST(coalesce((SELECT count(*) FILTER (WHERE severity = 'high') FROM queue), 0) AS BIGINT) AS high_priority_incidents,
  (SELECT max(event_ts) FROM silver) AS latest_event_at, true AS refreshed
FROM customer_health"""
    ),
)
def q_dashboard_overview(spark, sf_dir):
    lake = published_lake(spark, sf_dir)
    silver, queue, health = (current_table(spark, lake, t) for t in ("silver", "incident_queue", "customer_health"))
    row = dash.overview(health, queue, silver, last_refresh(spark, lake))
    # a run-time value: only whether it is there can be compared
    return row.withColumn("refreshed", F.col("last_pipeline_run_at").isNotNull()).drop("last_pipeline_run_at")


@register(
    "customer_ranking",
    o.incidents_sql(
        "SELECT customer_id, customer_health_score, risk_band, "
        "row_number() OVER (ORDER BY customer_health_score NULLS LAST, customer_id) AS health_rank "
        "FROM customer_health",
        days=90,
    ),
)
def q_customer_ranking(spark, sf_dir):
    health = build_customer_health(published(spark, sf_dir, "silver"), 90, ordered=False)
    return dash.customer_ranking(health).select("customer_id", "customer_health_score", "risk_band", "health_rank")


@register(
    "incident_top14",
    o.incidents_sql(f"SELECT {QUEUE_COLS} FROM queue ORDER BY {o.QUEUE_ORDER} LIMIT 14"),
)
def q_incident_top14(spark, sf_dir):
    return dash.dashboard_incidents(published(spark, sf_dir, "incident_queue")).select(*_qc)


_TOP_ID = f"(SELECT incident_id FROM incidents ORDER BY {o.QUEUE_ORDER} LIMIT 1)"


@register("incident_lookup", o.incidents_sql(f"SELECT {QUEUE_COLS} FROM incidents WHERE incident_id = {_TOP_ID}"))
def q_incident_lookup(spark, sf_dir):
    top = top_incidents(published(spark, sf_dir, "incident_queue"), 1).first()  # one row
    return dash.load_incident(published(spark, sf_dir, "incidents"), top["incident_id"] if top else "").select(*_qc)


@register(
    "customer_lookup",
    o.incidents_sql(
        "SELECT * FROM customer_health WHERE customer_id = "
        "(SELECT customer_id FROM customer_health ORDER BY customer_health_score NULLS LAST, customer_id LIMIT 1)"
    ),
)
def q_customer_lookup(spark, sf_dir):
    health = published(spark, sf_dir, "customer_health")
    worst = by_score(health).select("customer_id").first()  # one row
    return dash.load_customer_health(health, worst["customer_id"] if worst else "")


@register(
    "comparable_incidents",
    o.incidents_sql(
        f"""SELECT {QUEUE_COLS} FROM incidents
WHERE failure_category = (SELECT failure_category FROM incidents ORDER BY {o.QUEUE_ORDER} LIMIT 1)
  AND incident_id <> {_TOP_ID}
ORDER BY {o.QUEUE_ORDER} LIMIT 3"""
    ),
)
def q_comparable_incidents(spark, sf_dir):
    cands = published(spark, sf_dir, "incidents")
    top = top_incidents(published(spark, sf_dir, "incident_queue"), 1)
    return dash.comparable_incidents(
        cands, top.select("failure_category").scalar(), top.select("incident_id").scalar()
    ).select(*_qc)


@register(
    "activity_feed",
    "SELECT event_id, event_type AS kind, ts AS timestamp FROM events "
    "ORDER BY ts DESC NULLS LAST, event_id DESC NULLS LAST LIMIT 40",
)
def q_activity_feed(spark, sf_dir):
    (events,) = read_tables(spark, sf_dir, "events")
    return dash.activity_feed(events)


# ---- triage ---------------------------------------------------------------------------


@register(
    "triage_context",
    o.incidents_sql(
        "SELECT i.incident_id, i.customer_id, h.customer_health_score, h.open_incidents AS customer_open_incidents "
        "FROM incidents i JOIN customer_health h USING (customer_id)"
    ),
)
def q_triage_context(spark, sf_dir):
    _, cands, health = gold(spark, sf_dir)
    return triage_context(cands, health).select(
        "incident_id", "customer_id", "customer_health_score", "customer_open_incidents"
    )


@register(
    "triage_rejects",
    o.triage_sql(
        f"SELECT incident_id, {o.q('customer not found')} AS reason FROM incidents "
        "WHERE customer_id NOT IN (SELECT customer_id FROM customer_health) OR customer_id IS NULL "
        f"UNION ALL SELECT incident_id, {o.q('unknown failure category')} FROM incidents "
        "WHERE customer_id IN (SELECT customer_id FROM customer_health) "
        "AND (failure_category IS NULL OR failure_category NOT IN (SELECT failure_category FROM runbook))"
    ),
)
def q_triage_rejects(spark, sf_dir):
    _, cands, health = gold(spark, sf_dir)
    return triage_rejects(cands, health)


def _report(spark, sf_dir):
    _, cands, health = gold(spark, sf_dir)
    return build_triage(cands, health)


@register(
    "triage_runbook",
    o.triage_sql(
        "SELECT incident_id, root_cause, array_to_string(next_actions, ' | ') AS next_actions, "
        "array_to_string(deployment_plan, ' | ') AS deployment_plan FROM report"
    ),
)
def q_triage_runbook(spark, sf_dir):
    r = _report(spark, sf_dir)
    return r.select(
        "incident_id",
        "root_cause",
        F.array_join("next_actions", " | ").alias("next_actions"),
        F.array_join("deployment_plan", " | ").alias("deployment_plan"),
    )


@register("triage_text", o.triage_sql("SELECT incident_id, customer_update, executive_summary FROM report"))
def q_triage_text(spark, sf_dir):
    return _report(spark, sf_dir).select("incident_id", "customer_update", "executive_summary")


@register(
    "triage_evidence", o.triage_sql("SELECT incident_id, array_to_string(evidence, ' | ') AS evidence FROM report")
)
def q_triage_evidence(spark, sf_dir):
    return _report(spark, sf_dir).select("incident_id", F.array_join("evidence", " | ").alias("evidence"))


@register(
    "triage_comparables",
    o.triage_sql("SELECT incident_id, array_to_string(comparable_ids, ',') AS comparable_ids, matches FROM report"),
)
def q_triage_comparables(spark, sf_dir):
    r = _report(spark, sf_dir)
    return r.select(
        "incident_id",
        F.array_join(F.transform("comparable_incidents", lambda x: x["incident_id"]), ",").alias("comparable_ids"),
        F.size("comparable_incidents").cast("bigint").alias("matches"),
    )


def metrics_text(m):
    return F.array_join(
        F.transform(F.array_sort(F.map_keys(m)), lambda k: F.concat(k, F.lit("="), m[k])),
        ";",
    )


@register("triage_steps", o.triage_sql(o.TRIAGE_STEPS_BODY))
def q_triage_steps(spark, sf_dir):
    r = _report(spark, sf_dir)
    steps = r.select("incident_id", F.posexplode("steps").alias("pos", "step"))
    return steps.select(
        "incident_id",
        (F.col("pos") + 1).alias("step_no"),
        F.col("step.stage").alias("stage"),
        F.col("step.title").alias("title"),
        F.col("step.detail").alias("detail"),
        metrics_text(F.col("step.metrics")).alias("metrics_text"),
    )


_REPORT_SQL = (
    "SELECT incident_id, customer_id, customer_name, workload_name, severity, root_cause, executive_summary, "
    "customer_update, array_to_string(evidence, ' | ') AS evidence, "
    "array_to_string(next_actions, ' | ') AS next_actions, "
    "array_to_string(deployment_plan, ' | ') AS deployment_plan, "
    "array_to_string(comparable_ids, ',') AS comparable_ids, 5 AS step_count FROM report"
)


def _flat_report(r):
    return r.select(
        "incident_id",
        "customer_id",
        "customer_name",
        "workload_name",
        "severity",
        "root_cause",
        "executive_summary",
        "customer_update",
        F.array_join("evidence", " | ").alias("evidence"),
        F.array_join("next_actions", " | ").alias("next_actions"),
        F.array_join("deployment_plan", " | ").alias("deployment_plan"),
        F.array_join(F.transform("comparable_incidents", lambda x: x["incident_id"]), ",").alias("comparable_ids"),
        F.size("steps").alias("step_count"),
    )


@register("triage_report", o.triage_sql(_REPORT_SQL))
def q_triage_report(spark, sf_dir):
    return _flat_report(_report(spark, sf_dir))


@register("triage_queue_report", o.triage_sql(_REPORT_SQL, src="queue"))
def q_triage_queue_report(spark, sf_dir):
    """The original's own use: triage the 16 queued incidents, comparables from the queue."""
    _, cands, health = gold(spark, sf_dir)
    queue = top_incidents(cands)
    return _flat_report(build_triage(queue, health, pool=queue))


@register(
    "agent_runs_recent",
    o.triage_sql(
        "SELECT 'triage-' || incident_id AS id, incident_id, 'completed' AS status, "
        "strftime(event_ts, '%Y-%m-%dT%H:%M:%S') AS started_at, "
        "json_object('severity', severity, 'root_cause', root_cause, 'matches', matches)::VARCHAR AS summary_json "
        "FROM report ORDER BY started_at DESC NULLS LAST, id LIMIT 8"
    ),
)
def q_agent_runs_recent(spark, sf_dir):
    """The newest run rows that a triage of all published incidents has written."""
    lake = published_lake(spark, sf_dir)
    run_triage(spark, lake)
    return agent_runs(spark, lake).select("id", "incident_id", "status", "started_at", "summary_json")


@register(
    "pipeline_runs",
    o.incidents_sql(
        "SELECT 'completed' AS status, CAST(NULL AS VARCHAR) AS error_text, true AS finished, "
        "json_object('raw_rows', (SELECT count(*) FROM telemetry), 'feature_rows', (SELECT count(*) FROM silver), "
        "'incident_count', (SELECT count(*) FROM queue), 'customer_count', (SELECT count(*) FROM customer_health))::VARCHAR "
        "AS summary_json"
    ),
)
def q_pipeline_runs(spark, sf_dir):
    """H2: the row that the refresh left in the run log, first as running and then replaced."""
    runs = recent_runs(pipeline_runs(spark, published_lake(spark, sf_dir)))
    return runs.select("status", "error_text", F.col("finished_at").isNotNull().alias("finished"), "summary_json")


@register(
    "runbook_usage",
    o.triage_sql(
        "SELECT r.failure_category, r.rb_root_cause AS root_cause, count(i.incident_id) AS incidents "
        "FROM runbook r LEFT JOIN incidents i USING (failure_category) GROUP BY ALL"
    ),
)
def q_runbook_usage(spark, sf_dir):
    """A10: rows of the program as a table (the runbook), and how many incidents each entry has."""
    book = runbook_dimension(spark).select("failure_category", F.col("rb_root_cause").alias("root_cause"))
    counts = published(spark, sf_dir, "incidents").groupBy("failure_category").agg(F.count("incident_id").alias("n"))
    met = book.join(counts, "failure_category", "left")
    return met.select("failure_category", "root_cause", F.coalesce("n", F.lit(0)).alias("incidents"))
