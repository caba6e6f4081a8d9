"""Gold customer health over a trailing window.

Plan: the latest event is a scalar subquery (one global aggregate, partial
max per task); the window filter then applies to the silver scan. One pass
groups by the five keys with map-side partial aggregation, so a customer
holding a third of all runs costs one partial row per task, not a hot reducer,
and keeps each group's candidate for the worst workload. A window over the
groups of a customer picks the customer's; the runs are not read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlake.functions.exprs import clip, exact_mean_tenths, lit_d, num_text, r1

GROUP_KEYS = ["customer_id", "customer_name", "region", "account_tier", "cluster_name"]


def latest_event(silver: DataFrame) -> Column:
    """max(event_ts) over the whole table, as a scalar subquery."""
    return silver.select(F.max("event_ts")).scalar()


def recent_window(silver: DataFrame, days: int = 7, latest=None) -> DataFrame:
    """Runs with event_ts >= latest - days (both ends kept).

    ``latest`` defaults to the scalar subquery over ``silver``. A caller that
    reads a stored, time-sorted silver table passes the value itself (a
    datetime): a literal cutoff is pushed into the parquet scan, so min/max
    statistics skip the files outside the window.
    """
    top = latest_event(silver) if latest is None else F.lit(latest).cast("timestamp_ntz")
    cutoff = top - F.make_dt_interval(F.lit(days))
    return silver.filter(F.col("event_ts") >= cutoff)


def _group_measures() -> list[Column]:
    status, sev = F.col("status"), F.col("severity")
    return [
        F.count("job_id").alias("jobs_last_7d"),
        F.count_if(status == "failed").alias("failed_jobs"),
        F.count_if(status == "degraded").alias("degraded_jobs"),
        F.count_if(sev == "high").alias("open_incidents"),
        exact_mean_tenths("reliability_score").alias("avg_reliability_score"),
        F.avg("latency_over_sla_min").alias("avg_latency_over_sla_min"),
        F.avg("queue_depth").alias("avg_queue_depth"),
        F.avg("duration_min").alias("avg_duration_min"),
        r1(
            F.count_if(status == "success").cast("double") / F.count(F.lit(1)).cast("double") * F.lit(100)
        ).alias("success_rate_pct"),
    ]


def customer_aggregates(recent: DataFrame) -> DataFrame:
    """D3: per-customer counts and means; rows with a null key are dropped."""
    return recent.dropna(subset=GROUP_KEYS).groupBy(*GROUP_KEYS).agg(*_group_measures())


def first_in_reliability_order(column: str) -> Column:
    """Smallest (reliability, time, job; nulls last) with a non-null ``column``, as a struct that ends in it."""
    order = [x for c in ("reliability_score", "event_ts", "job_id") for x in (F.col(c).isNull(), F.col(c))]
    fields = [x.alias(f"k{i}") for i, x in enumerate(order)]
    return F.min(F.when(F.col(column).isNotNull(), F.struct(*fields, F.col(column).alias("value"))))


def worst_workload(recent: DataFrame) -> DataFrame:
    """Per customer, the first non-null workload / category in
    reliability order (nulls last; ties by event_ts, job_id)."""
    found = (
        recent.filter(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(
            first_in_reliability_order("workload_name").alias("w"),
            first_in_reliability_order("failure_category").alias("f"),
        )
    )
    return found.select(
        "customer_id", F.col("w.value").alias("at_risk_workload"), F.col("f.value").alias("dominant_failure")
    )


def health_score() -> Column:
    raw = (
        F.lit(100)
        - F.col("failed_jobs") * F.lit(6)
        - F.col("degraded_jobs") * lit_d(2.5)
        - F.col("open_incidents") * F.lit(4)
        - F.col("avg_latency_over_sla_min") * lit_d(0.4)
        - (F.lit(100) - F.col("avg_reliability_score")) * lit_d(0.35)
    )
    return r1(clip(raw, lower=25, upper=98))


def risk_band(score: Column) -> Column:
    return F.when(score < 45, "critical").when(score < 72, "watch").otherwise("healthy")


def exec_summary() -> Column:
    return F.concat(
        F.col("customer_name"),
        F.lit(" is trending "),
        F.col("risk_band"),
        F.lit(" with "),
        num_text(F.col("open_incidents")),
        F.lit(" high-severity incidents and "),
        num_text(F.col("success_rate_pct")),
        F.lit("% recent success."),
    )


def finish_health(grouped: DataFrame) -> DataFrame:
    """D4-D8 from one row for each group with its measures and worst candidates ``_w``, ``_f``."""
    own = Window.partitionBy("customer_id")
    health = (
        grouped.withColumn("at_risk_workload", F.min("_w").over(own)["value"])
        .withColumn("dominant_failure", F.min("_f").over(own)["value"])
        .drop("_w", "_f")
        .dropna(subset=GROUP_KEYS)
    )
    health = health.withColumn("customer_health_score", health_score())
    health = health.withColumn("risk_band", risk_band(F.col("customer_health_score")))
    return health.withColumn("exec_summary", exec_summary())


def by_score(health: DataFrame) -> DataFrame:
    """Score ascending."""
    return health.orderBy(F.col("customer_health_score").asc_nulls_last(), F.col("customer_id"))


def build_customer_health(silver: DataFrame, days: int = 7, ordered: bool = True, latest=None) -> DataFrame:
    """D1-D9 end to end. ``ordered`` applies D9 (score ascending); ``latest``
    see ``recent_window``."""
    recent = recent_window(silver, days, latest).filter(F.col("customer_id").isNotNull())
    health = finish_health(
        recent.groupBy(*GROUP_KEYS).agg(
            *_group_measures(),
            first_in_reliability_order("workload_name").alias("_w"),
            first_in_reliability_order("failure_category").alias("_f"),
        )
    )
    return by_score(health) if ordered else health
