"""Customer health from mergeable daily panes.

A pane is what one day adds to a customer's health: counts, exact sums and the
candidates for the worst workload, for each combination of the five keys.
Panes merge in any order and any number of times per day, so they are written
once when runs arrive, late ones included, and a window of any length is folded
from them: its work follows days and customers instead of runs. Only the day
that the window's start cuts through is taken from the runs themselves.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlake.functions.exprs import r1, tenths
from fleetlake.operators.health import GROUP_KEYS, by_score, finish_health, first_in_reliability_order

DAY = "day"
#: Averaged columns of health and the run columns they are means of.
_MEANS = {"avg_latency_over_sla_min": "latency_over_sla_min", "avg_queue_depth": "queue_depth", "avg_duration_min": "duration_min"}


def daily_panes(silver: DataFrame) -> DataFrame:
    """One row for each day and group of keys; runs without a time or a customer have no part in health."""
    runs = silver.filter(F.col("event_ts").isNotNull() & F.col("customer_id").isNotNull())
    status = F.col("status")
    sums = [x for c in _MEANS.values() for x in (F.sum(F.col(c).cast("double")).alias(f"sum_{c}"), F.count(c).alias(f"n_{c}"))]
    return runs.groupBy(F.to_date("event_ts").alias(DAY), *GROUP_KEYS).agg(
        F.count(F.lit(1)).alias("runs"),
        F.count("job_id").alias("jobs_last_7d"),
        F.count_if(status == "success").alias("succeeded"),
        F.count_if(status == "failed").alias("failed_jobs"),
        F.count_if(status == "degraded").alias("degraded_jobs"),
        F.count_if(F.col("severity") == "high").alias("open_incidents"),
        F.sum(tenths("reliability_score")).alias("sum_reliability_tenths"),
        F.count("reliability_score").alias("n_reliability"),
        *sums,
        first_in_reliability_order("workload_name").alias("_w"),
        first_in_reliability_order("failure_category").alias("_f"),
    )


def fold_panes(panes: DataFrame) -> DataFrame:
    """Measures of each group of keys over all days given."""
    kept = [c for c in panes.columns if c not in (DAY, *GROUP_KEYS, "_w", "_f")]
    total = panes.groupBy(*GROUP_KEYS).agg(
        *[F.sum(c).alias(c) for c in kept], F.min("_w").alias("_w"), F.min("_f").alias("_f")
    )
    reliability = F.col("sum_reliability_tenths").cast("double") / F.nullif(
        F.col("n_reliability").cast("double") * F.lit(10.0), F.lit(0.0)
    )
    means = [
        (F.col(f"sum_{c}") / F.nullif(F.col(f"n_{c}").cast("double"), F.lit(0.0))).alias(name) for name, c in _MEANS.items()
    ]
    share = F.col("succeeded").cast("double") / F.col("runs").cast("double") * F.lit(100)
    return total.select(
        *GROUP_KEYS,
        "jobs_last_7d",
        "failed_jobs",
        "degraded_jobs",
        "open_incidents",
        reliability.alias("avg_reliability_score"),
        *means,
        r1(share).alias("success_rate_pct"),
        "_w",
        "_f",
    )


def window_start(latest: dt.datetime, days: int) -> tuple[dt.datetime, dt.date]:
    """The first moment of the trailing window, and the day it cuts through."""
    cutoff = latest - dt.timedelta(days=days)
    return cutoff, cutoff.date()


def health_from_panes(panes: DataFrame, cut_day: DataFrame, days: int, latest: dt.datetime, ordered: bool = True) -> DataFrame:
    """D2-D9. ``cut_day`` are the runs of the day that the window's start lies in (further runs do no harm)."""
    cutoff, first = window_start(latest, days)
    day = F.to_date("event_ts")
    part = daily_panes(cut_day.filter((F.col("event_ts") >= F.lit(cutoff)) & (day == F.lit(first))))
    whole = panes.filter(F.col(DAY) > F.lit(first)).select(*part.columns)
    health = finish_health(fold_panes(whole.unionByName(part)))
    return by_score(health) if ordered else health
