"""Incremental refresh with Structured Streaming (K1, K2).

K1: raw telemetry files arrive in a folder; a file-source stream applies the
stateless silver scoring (the same ``score_silver`` as batch) and appends to
the silver table, with a checkpoint so a restarted query resumes where it
stopped (exactly-once file sink).

K2: health hangs on the latest event over ALL silver (a global maximum) and
its window starts in the middle of a day. Each micro-batch adds its daily panes
(``operators/panes``: mergeable counts, sums and worst runs), late runs
included, and health is folded from the panes of the window; silver is read
again only for the one day that the window's start cuts through. Panes and
silver are stored by event month first, so an epoch lists the months it needs
however many epochs there were. The incident queue is a top-k, so it is the
top-k of the last queue and the batch's incidents. All tables of an epoch are
written first and then committed by a row in an append-only log; readers take
the newest committed epoch, also when its tables are empty. The gold tables of
all but the last ``KEPT_EPOCHS`` epochs are removed.

Incident ids need a position over the whole table, so the stream's queue keeps
``job_id`` as its key; ids are assigned when gold is rebuilt in batch.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlake.functions.fixed_values import INCIDENT_QUEUE_SIZE
from fleetlake.operators.bronze import build_bronze
from fleetlake.operators.incidents import incident_candidates
from fleetlake.operators.panes import DAY, daily_panes, health_from_panes, window_start
from fleetlake.operators.position import sort_partitions
from fleetlake.operators.silver import score_silver


def bronze_stream(
    spark: SparkSession, source_dir: str, schema: T.StructType, files_per_trigger: int = 1000
) -> DataFrame:
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source_dir)
    return build_bronze(raw)


def silver_stream(
    spark: SparkSession, source_dir: str, schema: T.StructType, files_per_trigger: int = 1000
) -> DataFrame:
    return score_silver(bronze_stream(spark, source_dir, schema, files_per_trigger))


def run_silver_stream(
    spark: SparkSession,
    source_dir: str,
    schema: T.StructType,
    silver_dir: str,
    checkpoint_dir: str,
    files_per_trigger: int = 1000,
) -> None:
    """K1: process every file present now (availableNow), then stop."""
    q = (
        silver_stream(spark, source_dir, schema, files_per_trigger)
        .writeStream.format("parquet")
        .option("path", silver_dir)
        .option("checkpointLocation", checkpoint_dir)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()


HEALTH, QUEUE, PANES = "customer_health", "incident_queue", "_panes"
#: The first partition column: the first day of the event's month (a file per day and batch would be too small).
PERIOD = "event_month"
BATCH = "batch"
#: Epochs whose gold tables stay, for readers that are still at an older one.
KEPT_EPOCHS = 10


def _commit_dir(gold_dir: str) -> str:
    return f"{gold_dir.rstrip('/')}/_commits"


def committed_epoch(spark: SparkSession, gold_dir: str, before: int | None = None) -> int | None:
    """The newest committed epoch (smaller than ``before``)."""
    try:
        log = spark.read.schema("epoch BIGINT").json(_commit_dir(gold_dir))
    except AnalysisException:
        return None
    if before is not None:
        log = log.filter(F.col("epoch") < before)
    return log.agg(F.max("epoch")).first()[0]  # one value


def recent_silver(spark: SparkSession, silver_dir: str, schema: T.StructType, cutoff: dt.datetime) -> DataFrame:
    """Streamed silver from ``cutoff`` on: the period prunes folders, the time what is left."""
    stored = spark.read.schema(T.StructType([*schema.fields, T.StructField(PERIOD, T.DateType())]))
    return (
        stored.parquet(silver_dir)
        .filter((F.col(PERIOD) >= F.lit(cutoff.date().replace(day=1))) & (F.col("event_ts") >= F.lit(cutoff)))
        .drop(PERIOD, BATCH)
    )


def _by_month(df: DataFrame, time: str, epoch_id: int) -> DataFrame:
    return df.withColumns({PERIOD: F.trunc(time, "month"), BATCH: F.lit(epoch_id)})


def _store(placed: DataFrame, path: str) -> None:
    """Add the epoch's rows; written again, the epoch replaces its own folders only."""
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PERIOD, BATCH).parquet(path)


def _read_months(spark: SparkSession, path: str, schema: T.StructType, first: dt.date, last: dt.date) -> DataFrame:
    """Rows of the months from ``first`` to ``last``; other months' folders are not listed."""
    months, month = [], first.replace(day=1)
    while month <= last:
        months.append(month.isoformat())
        month = (month + dt.timedelta(days=32)).replace(day=1)
    stored = T.StructType([*schema.fields, T.StructField(PERIOD, T.DateType()), T.StructField(BATCH, T.LongType())])
    try:
        found = spark.read.schema(stored).option("basePath", path).parquet(f"{path}/{PERIOD}={{{','.join(months)}}}")
    except AnalysisException:  # none of the months has rows
        found = spark.createDataFrame([], stored)
    return found.drop(PERIOD, BATCH)


def _read_epoch(spark: SparkSession, path: str, schema: T.StructType, epoch_id: int) -> DataFrame:
    """Rows that one epoch stored; a folder of it is looked for in each month."""
    try:
        return spark.read.schema(schema).parquet(f"{path}/{PERIOD}=*/{BATCH}={epoch_id}")
    except AnalysisException:  # the epoch has no rows with a time
        return spark.createDataFrame([], schema)


def _forget(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stream_queue(incidents: DataFrame, n: int = INCIDENT_QUEUE_SIZE) -> DataFrame:
    """Top-n by severity, then newest; ``job_id`` breaks ties."""
    return incidents.orderBy(
        F.col("severity_rank").asc_nulls_last(), F.col("event_ts").desc_nulls_last(), F.col("job_id").asc_nulls_last()
    ).limit(n)


def run_gold_stream(
    spark: SparkSession,
    source_dir: str,
    schema: T.StructType,
    silver_dir: str,
    gold_dir: str,
    checkpoint_dir: str,
    days: int = 7,
    files_per_trigger: int = 1000,
) -> None:
    """K2: append silver and panes, fold customer health and the incident queue after every micro-batch.

    The latest event seen so far is carried from epoch to epoch as a one-row
    state file (previous state folded with the batch maximum), so the trailing
    window needs no scan of all silver. Runs without a time are in no window;
    they reach the queue only.
    """
    state_dir = f"{checkpoint_dir.rstrip('/')}/_latest_event"

    panes_dir = f"{gold_dir.rstrip('/')}/{PANES}"

    def refresh(bronze: DataFrame, epoch_id: int) -> None:
        sp, silver_schema = bronze.sparkSession, score_silver(bronze).schema
        timed = bronze.filter(F.col("event_ts").isNotNull())
        # moved before the scores are there and sorted as they are stored: rows are scored and written once;
        # panes, the latest event and the incidents come from the written rows
        tasks = sort_partitions(timed.count())
        moved = timed.repartitionByRange(*([tasks] if tasks else []), "event_ts", "job_id")
        placed = _by_month(moved, "event_ts", epoch_id).sortWithinPartitions(PERIOD, BATCH, "event_ts")
        _store(score_silver(placed), silver_dir)
        written = _read_epoch(sp, silver_dir, silver_schema, epoch_id)
        panes = daily_panes(written)
        _store(_by_month(panes, DAY, epoch_id), panes_dir)
        # the running latest event: this batch's maximum folded into the previous epoch's
        # state; the full state history is read only to recover a missing step
        batch_max = written.agg(F.max("event_ts").alias("latest"))
        try:
            prev = sp.read.parquet(f"{state_dir}/epoch={epoch_id - 1}")
        except AnalysisException:
            prev = None
            if epoch_id > 0:
                try:
                    hist = sp.read.parquet(state_dir)
                    prev = hist.filter(F.col("epoch") < epoch_id).select("latest")
                except AnalysisException:
                    prev = None
        running = batch_max if prev is None else batch_max.unionByName(prev.select("latest"))
        latest = running.agg(F.max("latest")).first()[0]  # one value
        sp.createDataFrame([(latest,)], "latest timestamp_ntz").write.mode("overwrite").parquet(
            f"{state_dir}/epoch={epoch_id}"
        )
        if latest is None:
            return
        cutoff, first = window_start(latest, days)
        cut_day = _read_months(sp, silver_dir, silver_schema, first, first).filter(
            (F.col("event_ts") >= F.lit(cutoff)) & (F.col("event_ts") < F.lit(dt.datetime.combine(first, dt.time()) + dt.timedelta(1)))
        )
        window = _read_months(sp, panes_dir, panes.schema, first, latest.date())
        health = health_from_panes(window, cut_day, days, latest, ordered=False)
        health.write.mode("overwrite").parquet(f"{gold_dir}/{HEALTH}/epoch={epoch_id}")
        untimed = score_silver(bronze.filter(F.col("event_ts").isNull()))
        incidents = incident_candidates(written.unionByName(untimed))
        last = committed_epoch(sp, gold_dir, before=epoch_id)
        if last is not None:
            incidents = incidents.unionByName(sp.read.parquet(f"{gold_dir}/{QUEUE}/epoch={last}"))
        stream_queue(incidents).write.mode("overwrite").parquet(f"{gold_dir}/{QUEUE}/epoch={epoch_id}")
        sp.createDataFrame([(epoch_id,)], "epoch BIGINT").coalesce(1).write.mode("append").json(_commit_dir(gold_dir))
        for table in (HEALTH, QUEUE):
            _forget(sp, f"{gold_dir}/{table}/epoch={epoch_id - KEPT_EPOCHS}")

    q = (
        bronze_stream(spark, source_dir, schema, files_per_trigger)
        .writeStream.foreachBatch(refresh)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()


def latest_gold(spark: SparkSession, gold_dir: str, table: str = HEALTH) -> DataFrame:
    """``table`` of the newest committed micro-batch."""
    last = committed_epoch(spark, gold_dir)
    if last is None:
        raise FileNotFoundError(f"no committed epoch under {gold_dir}")
    return spark.read.parquet(f"{gold_dir}/{table}/epoch={last}")
