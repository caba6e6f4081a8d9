"""Silver: per-run scores, severity, lookups and text.

Everything except the incident id is a stateless column expression, so the
same ``score_silver`` runs in batch and in Structured Streaming. The incident
id needs each run's position in event order over the whole table (C1); it is
added by ``with_incident_ids`` using the distributed position operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlake.functions.exprs import clip, lit_d, lookup, r1, safe_div, spaced
from fleetlake.functions.fixed_values import (
    ACTION_BY_CATEGORY,
    ROOT_CAUSE_BY_CATEGORY,
    SEVERITY_RANK,
    SEVERITY_RANK_OTHER,
    STATUS_PENALTY,
)
from fleetlake.operators.position import number_rows, positions_from_numbered, with_global_position

def status_penalty(status="status"):
    out = F.lit(0.0)
    for name, value in reversed(list(STATUS_PENALTY.items())):
        out = F.when(F.col(status) == F.lit(name), lit_d(value)).otherwise(out)
    return out


def penalty(latency):
    """C6+C7: the reliability penalty, in the original's operand order."""
    raw = (
        latency * lit_d(0.65)
        + F.col("failed_tasks") * lit_d(0.85)
        + F.col("retried_tasks") * lit_d(0.28)
        + F.col("queue_depth") * lit_d(1.1)
        + F.col("spill_gb") * lit_d(0.95)
        + clip(F.col("memory_utilization_pct") - F.lit(70), lower=0) * lit_d(0.42)
    )
    return raw + status_penalty()


def severity(status, rel, latency, queue):
    return (
        F.when(
            (status == F.lit("failed")) | (rel < F.lit(38)) | (latency > F.lit(40)) | (queue > F.lit(14)),
            F.lit("high"),
        )
        .when((status == F.lit("degraded")) | (rel < F.lit(68)) | (latency > F.lit(15)), F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def severity_rank(sev):
    return F.coalesce(lookup(SEVERITY_RANK, sev), F.lit(SEVERITY_RANK_OTHER))


def customer_summary():
    return F.concat(
        F.col("customer_name"),
        F.lit(" "),
        F.col("workload_name"),
        F.lit(" is "),
        F.col("status"),
        F.lit(" because of "),
        spaced(F.col("failure_category")),
        F.lit("."),
    )


def score_silver(bronze: DataFrame) -> DataFrame:
    """Scores, severity, lookups, customer summary (stateless).

    Raw (unclipped) values are staged as columns first: ``clip`` reads its
    input three times, and a column reference keeps the plan small where an
    inlined expression tree would triple (the optimizer does not re-inline an
    expensive expression that is used more than once).
    """
    raw = bronze.withColumns(
        {
            "_fl_lat": F.col("duration_min") - F.col("sla_minutes"),
            "_fl_mem": clip(F.col("memory_utilization_pct") - F.lit(68), lower=0) * lit_d(0.8)
            + F.col("spill_gb") * lit_d(1.7),
            "_fl_queue": F.col("queue_depth") / F.lit(20) * F.lit(100),
            "_fl_shuffle": safe_div(F.col("shuffle_gb"), F.col("input_rows_m")),
        }
    )
    out = raw.withColumns(
        {
            "latency_over_sla_min": clip(F.col("_fl_lat"), lower=0),
            "memory_pressure_score": r1(F.col("_fl_mem")),
            "queue_pressure_score": r1(clip(F.col("_fl_queue"), lower=0, upper=100)),
            "shuffle_pressure_score": r1(clip(F.col("_fl_shuffle"), lower=0.4) * lit_d(16)),
        }
    )
    out = out.withColumn("_fl_rel", F.lit(100) - penalty(F.col("latency_over_sla_min")))
    out = out.withColumn("reliability_score", r1(clip(F.col("_fl_rel"), lower=8, upper=99)))
    sev = severity(F.col("status"), F.col("reliability_score"), F.col("latency_over_sla_min"), F.col("queue_depth"))
    out = out.withColumn("severity", sev)
    return out.withColumns(
        {
            "severity_rank": severity_rank(F.col("severity")).cast("int"),
            "root_cause_guess": lookup(ROOT_CAUSE_BY_CATEGORY, F.col("failure_category")),
            "recommended_action": lookup(ACTION_BY_CATEGORY, F.col("failure_category")),
            "customer_summary": customer_summary(),
        }
    ).drop("_fl_lat", "_fl_mem", "_fl_queue", "_fl_shuffle", "_fl_rel")


def incident_id_expr(position):
    """``inc-<first part of customer_id>-<MMdd>-<position, at least 4 digits>``."""
    return F.concat(
        F.lit("inc-"),
        F.substring_index(F.col("customer_id"), "-", 1),
        F.lit("-"),
        F.date_format(F.col("event_ts"), "MMdd"),
        F.lit("-"),
        F.format_string("%04d", position),
    )


def incident_order():
    """Event order for positions: event_ts, then job_id (nulls last)."""
    return [F.col("event_ts").asc_nulls_last(), F.col("job_id").asc_nulls_last()]


def with_incident_ids(df: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """Position in (event_ts, job_id) order over the whole table, from 0."""
    positioned = with_global_position(df, incident_order(), "_fl_pos", num_partitions)
    return positioned.withColumn("incident_id", incident_id_expr(F.col("_fl_pos"))).drop("_fl_pos")


def number_bronze(bronze: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """Bronze sorted by event time and renumbered (block + row-in-block),
    to be stored; the stored numbering gives incident positions without a
    second materialisation."""
    return number_rows(bronze, incident_order(), num_partitions)


def build_silver(bronze: DataFrame, num_partitions: int | None = None) -> DataFrame:
    return score_silver(with_incident_ids(bronze, num_partitions))


def build_silver_from_numbered(stored_bronze: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """Silver from a STORED ``number_bronze`` table (no checkpoint needed); with the
    count that numbered it, a task holds one block of neighbouring runs."""
    positioned = positions_from_numbered(stored_bronze, "_fl_pos", num_partitions)
    return score_silver(positioned.withColumn("incident_id", incident_id_expr(F.col("_fl_pos"))).drop("_fl_pos"))
