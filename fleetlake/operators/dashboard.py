"""Dashboard overview and lookups.

Lookups are filters, so Spark pushes them into the parquet scan (and prunes
partitions when the stored table is partitioned on the filtered column).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlake.functions.exprs import exact_mean_tenths, r1
from fleetlake.functions.fixed_values import ACTIVITY_FEED_SIZE, COMPARABLE_LIMIT, DASHBOARD_INCIDENTS
from fleetlake.operators.incidents import queue_order, top_incidents
from fleetlake.operators.position import with_global_position


def overview(health: DataFrame, queue: DataFrame, silver: DataFrame, last_run_at: Column | None = None) -> DataFrame:
    """one row. Three global aggregates; the queue and silver ones are
    scalar subqueries (each a single-row result), so nothing is joined."""
    high = queue.select(F.count_if(F.col("severity") == "high")).scalar()
    latest = silver.select(F.max("event_ts")).scalar()
    row = health.agg(
        F.count(F.lit(1)).alias("customer_count"),
        F.coalesce(r1(exact_mean_tenths("customer_health_score")), F.lit(0.0)).alias("average_health_score"),
        F.coalesce(F.sum("jobs_last_7d"), F.lit(0)).cast("bigint").alias("jobs_last_7d"),
    )
    row = row.withColumns(
        {
            "high_priority_incidents": F.coalesce(high, F.lit(0)).cast("bigint"),
            "latest_event_at": latest,
        }
    )
    if last_run_at is not None:
        row = row.withColumn("last_pipeline_run_at", last_run_at)
    return row


def customer_ranking(health: DataFrame) -> DataFrame:
    """customers by health ascending, with their 1-based rank."""
    order = [F.col("customer_health_score").asc_nulls_last(), F.col("customer_id").asc_nulls_last()]
    ranked = with_global_position(health, order, "_fl_rank")
    return ranked.withColumn("health_rank", F.col("_fl_rank") + 1).drop("_fl_rank").orderBy("health_rank")


def dashboard_incidents(queue: DataFrame, n: int = DASHBOARD_INCIDENTS) -> DataFrame:
    """the first n incidents of the queue."""
    return top_incidents(queue, n)


def load_incident(incidents: DataFrame, incident_id) -> DataFrame:
    """the incident with this id (zero rows when absent)."""
    key = F.lit(incident_id) if isinstance(incident_id, str) else incident_id
    return incidents.filter(F.col("incident_id") == key)


def load_customer_health(health: DataFrame, customer_id) -> DataFrame:
    """the health row of one customer (zero rows when absent)."""
    key = F.lit(customer_id) if isinstance(customer_id, str) else customer_id
    return health.filter(F.col("customer_id") == key)


def comparable_incidents(
    incidents: DataFrame, failure_category, exclude_incident_id, limit: int = COMPARABLE_LIMIT
) -> DataFrame:
    """same category, not this incident, first ``limit`` in queue order."""
    cat = F.lit(failure_category) if isinstance(failure_category, str) else failure_category
    exc = F.lit(exclude_incident_id) if isinstance(exclude_incident_id, str) else exclude_incident_id
    return (
        incidents.filter((F.col("failure_category") == cat) & (F.col("incident_id") != exc))
        .orderBy(*queue_order())
        .limit(limit)
    )


def activity_feed(events: DataFrame, n: int = ACTIVITY_FEED_SIZE) -> DataFrame:
    """newest n events (kind, detail, timestamp)."""
    return (
        events.select(
            F.col("event_id"),
            F.col("event_type").alias("kind"),
            F.col("ts").alias("timestamp"),
        )
        .orderBy(F.col("timestamp").desc_nulls_last(), F.col("event_id").desc_nulls_last())
        .limit(n)
    )
