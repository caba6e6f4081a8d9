"""Gold incident queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlake.functions.exprs import num_text, spaced
from fleetlake.functions.fixed_values import INCIDENT_QUEUE_SIZE


def is_incident() -> Column:
    """Severity high/medium, or status other than success (null counts)."""
    return F.col("severity").isin("high", "medium") | ~F.col("status").eqNullSafe(F.lit("success"))


def summary_line() -> Column:
    return F.concat(
        spaced(F.col("failure_category")),
        F.lit(" on "),
        F.col("workload_name"),
        F.lit(" for "),
        F.col("customer_name"),
        F.lit(" with reliability "),
        num_text(F.col("reliability_score")),
        F.lit("."),
    )


def with_incident_text(incidents: DataFrame) -> DataFrame:
    """The columns that incidents have besides those of silver."""
    return incidents.withColumns(
        {
            "needs_customer_update": F.col("severity").eqNullSafe(F.lit("high")),
            "summary_line": summary_line(),
        }
    )


def incident_candidates(silver: DataFrame) -> DataFrame:
    """E1-E3 over every run: the full incident table (no queue cut)."""
    return with_incident_text(silver.filter(is_incident()))


def queue_order() -> list[Column]:
    """Severity rank ascending, newest first; incident id breaks ties."""
    return [
        F.col("severity_rank").asc_nulls_last(),
        F.col("event_ts").desc_nulls_last(),
        F.col("incident_id").asc_nulls_last(),
    ]


def top_incidents(incidents: DataFrame, n: int = INCIDENT_QUEUE_SIZE) -> DataFrame:
    """Top-n (planned as TakeOrderedAndProject: per-task top-n, then merge)."""
    return incidents.orderBy(*queue_order()).limit(n)


def top_stored_incidents(incidents: DataFrame, n: int = INCIDENT_QUEUE_SIZE) -> DataFrame:
    """E4 of a stored table: ``top_incidents``, whose rows are read in whole only as far as the queue reaches.

    Three columns tell the rank and time of the last queued row; row groups
    without such a rank are skipped, and other rows are dropped where they are read.
    """
    rank, time = F.col("severity_rank"), F.col("event_ts")
    keys = top_incidents(incidents.select("severity_rank", "event_ts", "incident_id"), n)
    found = keys.select("severity_rank", time.cast("string").alias("time")).tail(1) if n > 0 else []  # one row
    if not found or found[0]["severity_rank"] is None:
        return top_incidents(incidents, n)
    last = found[0]
    same = rank == F.lit(last["severity_rank"])
    if last["time"] is not None:  # rows without a time come after all others of their rank
        same &= time >= F.lit(last["time"]).cast(incidents.schema["event_ts"].dataType)
    return top_incidents(incidents.filter((rank < F.lit(last["severity_rank"])) | same), n)


def build_incident_queue(silver: DataFrame, n: int = INCIDENT_QUEUE_SIZE) -> DataFrame:
    return top_incidents(incident_candidates(silver), n)
