"""Medallion queries: bronze, silver and customer health (B, C, D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlake.operators.bronze import build_bronze
from fleetlake.operators.health import build_customer_health, customer_aggregates, recent_window, worst_workload
from fleetlake.operators.silver import build_silver, score_silver
from fleetlake.plans import oracle as o
from fleetlake.plans.catalog import register
from fleetlake.sources.telemetry import load_telemetry

HEALTH_COLUMNS = (
    "customer_id, customer_name, region, account_tier, cluster_name, jobs_last_7d, failed_jobs, "
    "degraded_jobs, open_incidents, avg_reliability_score, avg_latency_over_sla_min, avg_queue_depth, "
    "avg_duration_min, success_rate_pct, at_risk_workload, dominant_failure, customer_health_score, "
    "risk_band, exec_summary"
)


def silver_of(spark, sf_dir, ids: bool = True):
    tel = load_telemetry(spark, sf_dir)
    return build_silver(tel) if ids else score_silver(tel)


@register("bronze", o.with_ctes(o.TELEMETRY, body="SELECT * FROM telemetry"))
def q_bronze(spark, sf_dir):
    tel = load_telemetry(spark, sf_dir)
    # the raw feed carries event_ts as text (minutes) and the date as text
    raw = tel.withColumn("event_ts", F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm"))
    return build_bronze(raw).drop("ingested_at")


@register("incident_ids", o.silver_sql("SELECT job_id, event_ts, incident_id FROM silver"))
def q_incident_ids(spark, sf_dir):
    return silver_of(spark, sf_dir).select("job_id", "event_ts", "incident_id")


@register(
    "silver_scores",
    o.silver_sql(
        "SELECT job_id, latency_over_sla_min, memory_pressure_score, queue_pressure_score, "
        "shuffle_pressure_score, reliability_score FROM silver"
    ),
)
def q_silver_scores(spark, sf_dir):
    return silver_of(spark, sf_dir, ids=False).select(
        "job_id",
        "latency_over_sla_min",
        "memory_pressure_score",
        "queue_pressure_score",
        "shuffle_pressure_score",
        "reliability_score",
    )


@register("severity", o.silver_sql("SELECT job_id, status, reliability_score, severity, severity_rank FROM silver"))
def q_severity(spark, sf_dir):
    return silver_of(spark, sf_dir, ids=False).select(
        "job_id", "status", "reliability_score", "severity", "severity_rank"
    )


@register(
    "root_cause_lookup",
    o.silver_sql("SELECT job_id, failure_category, root_cause_guess, recommended_action, user_impact FROM silver"),
)
def q_root_cause(spark, sf_dir):
    return silver_of(spark, sf_dir, ids=False).select(
        "job_id", "failure_category", "root_cause_guess", "recommended_action", "user_impact"
    )


@register("silver_text", o.silver_sql("SELECT job_id, ticket_hint, customer_summary FROM silver"))
def q_silver_text(spark, sf_dir):
    return silver_of(spark, sf_dir, ids=False).select("job_id", "ticket_hint", "customer_summary")


@register(
    "recent_window",
    o.with_ctes(o.TELEMETRY, o.SILVER, o.recent(7), body="SELECT job_id, customer_id, event_ts FROM recent"),
)
def q_recent_window(spark, sf_dir):
    return recent_window(silver_of(spark, sf_dir, ids=False), 7).select("job_id", "customer_id", "event_ts")


@register(
    "customer_agg",
    o.health_sql(
        90,
        "SELECT customer_id, customer_name, region, account_tier, cluster_name, jobs_last_7d, failed_jobs, "
        "degraded_jobs, open_incidents, avg_reliability_score, avg_latency_over_sla_min, avg_queue_depth, "
        "avg_duration_min, success_rate_pct FROM grouped",
    ),
)
def q_customer_agg(spark, sf_dir):
    return customer_aggregates(recent_window(silver_of(spark, sf_dir, ids=False), 90))


@register("worst_workload", o.health_sql(90, "SELECT * FROM worst"))
def q_worst_workload(spark, sf_dir):
    return worst_workload(recent_window(silver_of(spark, sf_dir, ids=False), 90))


@register("customer_health", o.health_sql(7, f"SELECT {HEALTH_COLUMNS} FROM customer_health"))
def q_customer_health(spark, sf_dir):
    return build_customer_health(silver_of(spark, sf_dir, ids=False), 7).select(
        *[c.strip() for c in HEALTH_COLUMNS.split(",")]
    )


@register("customer_health_90d", o.health_sql(90, f"SELECT {HEALTH_COLUMNS} FROM customer_health"))
def q_customer_health_90d(spark, sf_dir):
    return build_customer_health(silver_of(spark, sf_dir, ids=False), 90).select(
        *[c.strip() for c in HEALTH_COLUMNS.split(",")]
    )
