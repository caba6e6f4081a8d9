"""The medallion refresh: raw -> bronze -> silver -> two gold tables.

Each layer is a function ``DataFrame -> DataFrame``; this module only wires
them to storage. Silver is written once and re-read, because both gold tables
and the dashboard use it (no recomputation of the incident positions). Every
refresh writes new version directories and then the manifest that names
them, so readers never see a half-replaced table.

Layouts: raw as it came; bronze by bins of neighbouring dates that hold about
``BIN_ROWS`` runs, in event order, so that neither a small day makes a folder of
tiny files nor a large one a single task (customer_id is not a partition column:
at scale it would make too many small files); silver and the full incident table
by severity, customer health by risk_band, the incident queue by severity.
Incidents and health carry Bloom filters of their ids for lookups.

A refresh and a triage run write a row into the run log when they start and
another when they end, also when they fail.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlake.functions.exprs import iso_seconds, utc_now_text
from fleetlake.functions.fixed_values import AGENT_RUNS_SHOWN
from fleetlake.operators.bronze import build_bronze
from fleetlake.operators.health import build_customer_health
from fleetlake.operators.incidents import incident_candidates, is_incident, top_stored_incidents, with_incident_text
from fleetlake.operators.keyed import read_rows, upsert_rows
from fleetlake.operators.position import sort_partitions
from fleetlake.operators.runlog import (
    AGENT_RUNS_SCHEMA,
    PIPELINE_RUNS_SCHEMA,
    SEQ,
    encode_summary,
    recent_runs,
    run_record,
)
from fleetlake.operators.silver import build_silver_from_numbered, number_bronze
from fleetlake.operators.triage import build_triage
from fleetlake.sources.files import publish_version
from fleetlake.sources.records import MANIFEST_SCHEMA, load_manifest, manifest_row, persist_manifest

#: Runs that a folder of bronze aims at; a date with more is a folder of its own.
BIN_ROWS = 1 << 20
#: A date is a row of 30 bytes; up to this many are broadcast to their rows, more are joined by a shuffle.
MAX_BROADCAST_DATES = 1 << 18
DATE_BIN = "dates_from"
_WITH_SEQ = f", {SEQ} bigint"


@dataclass
class Layout:
    base: str

    def table(self, name: str) -> str:
        return f"{self.base.rstrip('/')}/{name}"

    @property
    def manifest(self) -> str:
        return f"{self.base.rstrip('/')}/_system/pipeline_state"

    @property
    def pipeline_runs(self) -> str:
        return f"{self.base.rstrip('/')}/_system/pipeline_runs"

    @property
    def agent_runs(self) -> str:
        return f"{self.base.rstrip('/')}/_system/agent_runs"


def _now() -> str:
    return datetime.now(timezone.utc).replace(microsecond=0).isoformat()


def _ddl(schema) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields) + _WITH_SEQ


def _log_pipeline_run(spark: SparkSession, layout: Layout, run_id: str, started: str, status: str, summary=None, error=None):
    """H2, H1: the run's row, replacing the one it had."""
    finished = F.lit(None).cast("string") if status == "running" else utc_now_text()
    row = spark.range(1).select(
        *run_record(F.lit(run_id), F.lit(status), F.lit(started), finished, summary, F.lit(error).cast("string")),
        F.unix_micros(F.current_timestamp()).alias(SEQ),
    )
    upsert_rows(spark, layout.pipeline_runs, row, _ddl(PIPELINE_RUNS_SCHEMA))


def _logged(spark: SparkSession, layout: Layout, run_id: str, work: Callable[[str], DataFrame]) -> DataFrame:
    started = _now()
    _log_pipeline_run(spark, layout, run_id, started, "running")
    try:
        manifest = work(started)
    except Exception as e:
        _log_pipeline_run(spark, layout, run_id, started, "failed", error=f"{type(e).__name__}: {e}"[:1000])
        raise
    m = manifest.first()  # one row
    counts = ("raw_rows", "feature_rows", "incident_count", "customer_count")
    _log_pipeline_run(
        spark, layout, run_id, started, "completed", encode_summary({c: F.lit(m[c]).cast("bigint") for c in counts})
    )
    return manifest


def date_bins(rows: DataFrame, bin_rows: int = BIN_ROWS, date: str = "partition_date") -> DataFrame:
    """``date`` and the first date of its bin. Neighbouring dates share a bin until it has ``bin_rows`` rows.

    One row a date, in one window: calendars are short.
    """
    counts = rows.groupBy(F.col(date).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    # a date opens a bin where the rows before it pass a multiple of the aim
    nth = F.expr(f"coalesce(sum(n) OVER (ORDER BY d NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) div {bin_rows}")
    binned = counts.withColumn("bin", nth)
    first = F.coalesce(F.min("d").over(Window.partitionBy("bin")), F.lit("none"))
    return binned.select("d", first.alias(DATE_BIN))


def _in_bins(bronze: DataFrame, raw: DataFrame, bin_rows: int) -> DataFrame:
    bins = date_bins(build_bronze(raw, stamp=False), bin_rows)
    small = bins.count() <= MAX_BROADCAST_DATES
    met = bronze.join(F.broadcast(bins) if small else bins, F.col("partition_date").eqNullSafe(F.col("d")))
    return met.drop("d")


def run_feature_pipeline(
    spark: SparkSession, raw: DataFrame, base: str, days: int = 7, raw_path: str | None = None, bin_rows: int = BIN_ROWS
) -> DataFrame:
    """Refresh every table under ``base``; returns the manifest row.

    ``raw_path`` names where ``raw`` is stored; without it the rows are
    published as the refresh's raw table first, so that they are computed once.
    """
    layout = Layout(base)
    run_id = f"pipe-{uuid.uuid4().hex[:8]}"

    def work(started: str) -> DataFrame:
        return _refresh(spark, raw, layout, run_id, started, days, raw_path, bin_rows)

    return _logged(spark, layout, run_id, work)


def _refresh(spark, raw, layout: Layout, version: str, started: str, days: int, raw_path: str | None, bin_rows: int) -> DataFrame:
    if raw_path is None:
        raw_path = f"{layout.table('raw')}/version={version}"
        raw.write.mode("overwrite").parquet(raw_path)
        raw = spark.read.schema(raw.schema).parquet(raw_path)
    # Bronze is stored sorted by event time and renumbered; silver takes the
    # incident positions from that stored numbering (one materialisation, not two)
    # each of the three sorts holds its rows in memory: their tasks are counted by rows
    tasks = sort_partitions(raw.count())
    bronze = number_bronze(_in_bins(build_bronze(raw), raw, bin_rows), tasks)
    bronze_path = f"{layout.table('bronze')}/version={version}"
    # rows arrive range-partitioned by event time, so each task writes few bins
    bronze.write.mode("overwrite").partitionBy(DATE_BIN).parquet(bronze_path)
    stored_bronze = spark.read.schema(bronze.drop(DATE_BIN).schema).parquet(bronze_path)
    order = ["event_ts", "job_id"]
    # bronze's blocks are tasks again, so the scores are computed once and not for a sample of ranges too
    silver_df = build_silver_from_numbered(stored_bronze, tasks)
    silver_path = publish_version(
        silver_df, layout.table("silver"), version, ["severity"], order, tasks=tasks, dealt=tasks is not None
    )
    silver = spark.read.schema(silver_df.schema).parquet(silver_path)
    # D1 as one value: the literal cutoff is pushed into the scan of the
    # time-sorted silver files (a subquery cutoff would not be)
    latest = silver.agg(F.max("event_ts")).first()[0]
    health = build_customer_health(silver, days, ordered=False, latest=latest)
    health_path = publish_version(
        health, layout.table("customer_health"), version, ["risk_band"], ["customer_id"], ["customer_id"]
    )
    incidents_path = publish_version(
        silver.filter(is_incident()),
        layout.table("incidents"),
        version,
        ["severity"],
        order,
        ["incident_id"],
        tasks,
        finish=with_incident_text,
    )
    incidents = spark.read.schema(incident_candidates(silver).schema).parquet(incidents_path)
    queue_path = publish_version(top_stored_incidents(incidents), layout.table("incident_queue"), version, ["severity"])

    counts = {
        "raw_rows": stored_bronze.select(F.count(F.lit(1))).scalar(),
        "feature_rows": silver.select(F.count(F.lit(1))).scalar(),
        "incident_count": spark.read.parquet(queue_path).select(F.count(F.lit(1))).scalar(),
        "customer_count": spark.read.parquet(health_path).select(F.count(F.lit(1))).scalar(),
    }
    paths = {
        "raw": raw_path,
        "bronze": bronze_path,
        "silver": silver_path,
        "customer_health": health_path,
        "incidents": incidents_path,
        "incident_queue": queue_path,
    }
    manifest = manifest_row(spark, version, started, counts, paths, finished_at=utc_now_text())
    persist_manifest(manifest, layout.manifest)
    # this run's row, as stored (the log may hold other runs)
    return spark.read.schema(MANIFEST_SCHEMA).json(layout.manifest).filter(F.col("run_id") == version)


def run_triage(spark: SparkSession, base: str) -> DataFrame:
    """Triage every published incident; the reports are published and each incident's run row is upserted (H1, H2)."""
    layout, version = Layout(base), f"triage-{uuid.uuid4().hex[:8]}"
    reports = build_triage(current_table(spark, base, "incidents"), current_table(spark, base, "customer_health"))
    path = publish_version(reports, layout.table("triage_reports"), version)
    stored = spark.read.schema(reports.schema).parquet(path)
    summary = encode_summary(
        {"severity": F.col("severity"), "root_cause": F.col("root_cause"), "matches": F.size("comparable_incidents")}
    )
    started, nothing = iso_seconds("incident_ts"), F.lit(None).cast("string")
    record = run_record(F.col("run_id"), F.lit("completed"), started, utc_now_text(), summary, nothing)
    rows = stored.select(record[0], "incident_id", *record[1:], F.unix_micros(F.current_timestamp()).alias(SEQ))
    upsert_rows(spark, layout.agent_runs, rows, _ddl(AGENT_RUNS_SCHEMA))
    return stored


def pipeline_runs(spark: SparkSession, base: str) -> DataFrame:
    """The current row of every refresh."""
    return read_rows(spark, Layout(base).pipeline_runs, _ddl(PIPELINE_RUNS_SCHEMA)).drop(SEQ)


def agent_runs(spark: SparkSession, base: str, n: int = AGENT_RUNS_SHOWN) -> DataFrame:
    """H3: the newest triage runs."""
    return recent_runs(read_rows(spark, Layout(base).agent_runs, _ddl(AGENT_RUNS_SCHEMA)).drop(SEQ), n)


def last_refresh(spark: SparkSession, base: str):
    """When the newest refresh ended, as a scalar column (null before the first)."""
    return load_manifest(spark, Layout(base).manifest).select("finished_at").scalar()


def current_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Read the version of ``name`` the manifest points to."""
    m = load_manifest(spark, Layout(base).manifest)
    path = m.select(F.col("output_paths")[name]).first()  # one row, one string
    if path is None or path[0] is None:
        raise FileNotFoundError(f"no published version of {name} under {base}")
    return spark.read.parquet(path[0])
