"""Silver kept by period, with incident numbers and health panes that grow with late runs (C1, D, F4).

A period (a day, or a month where days are small) is the unit of rewriting.
Its runs are stored in event order, each with the block it was sorted in and
its place there. The index has a row for each block of each period: how many
runs it has, and its first place. A run's position over the whole table is the
running sum of the index up to its block plus its place, so an incident number
is computed when it is read. Adding late runs rewrites the periods they fall
in, and the index; the numbers of all later runs move without touching them.

Every ``add_runs`` writes new folders and becomes visible by one commit that
only one writer can make (``sources/commits``). The writer that loses starts
over from the winner's state. Readers keep the version they began with.

The index is one row a period and sorting block. It is broadcast while it has
at most ``MAX_BROADCAST_ROWS`` rows, and joined by a shuffle beyond.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlake.operators.dashboard import load_incident
from fleetlake.operators.panes import DAY, daily_panes, health_from_panes, window_start
from fleetlake.operators.position import BLOCK, ROW, number_rows, sort_partitions
from fleetlake.operators.silver import incident_id_expr, incident_order
from fleetlake.sources.commits import at_version, commit, newest

MAX_BROADCAST_ROWS = 1 << 19
PERIOD = "period"
#: Folder of the runs without a time; they are last in event order.
NO_TIME = "none"
INDEX_SCHEMA = f"{PERIOD} string, batch string, {BLOCK} int, lo bigint, rows bigint, latest timestamp_ntz"


@dataclass
class Timeline:
    """Where one version's rows are. ``places``: batch folder of each period."""

    spark: SparkSession
    base: str
    version: int
    grain: str
    index_path: str | None
    schema: T.StructType | None
    panes_schema: T.StructType | None
    places: dict[str, str]

    def index(self) -> DataFrame:
        if self.index_path is None:
            return self.spark.createDataFrame([], INDEX_SCHEMA)
        return self.spark.read.schema(INDEX_SCHEMA).parquet(self.index_path)

    def _read(self, kind: str, schema: T.StructType, periods: list[str]) -> DataFrame:
        if not periods:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.base}/{kind}/batch={self.places[p]}/{PERIOD}={p}" for p in periods]
        return self.spark.read.schema(schema).parquet(*paths)

    def stored(self, periods: list[str] | None = None) -> DataFrame:
        """Runs as stored, with their period."""
        chosen = sorted(self.places) if periods is None else [p for p in periods if p in self.places]
        schema = _with_period(self.schema.fields)
        spark, root = self.spark, f"{self.base}/runs"
        if not chosen:
            return spark.createDataFrame([], schema)
        paths = [f"{root}/batch={self.places[p]}/{PERIOD}={p}" for p in chosen]
        # basePath makes a column of the period (and of the batch, which is of no use)
        return spark.read.schema(schema).option("basePath", root).parquet(*paths).drop("batch")

    def silver(self, periods: list[str] | None = None) -> DataFrame:
        """Runs with their incident numbers."""
        index = self.index()
        rows = F.broadcast(self._firsts(index)) if index.count() <= MAX_BROADCAST_ROWS else self._firsts(index)
        met = self.stored(periods).join(rows, [PERIOD, BLOCK])
        return (
            met.withColumn("incident_id", incident_id_expr(F.col("first") + F.col(ROW) - F.col("lo")))
            .drop(PERIOD, BLOCK, ROW, "first", "lo")
        )

    def _firsts(self, index: DataFrame) -> DataFrame:
        # runs without a time have the greatest period, as "none" sorts after all dates
        before = Window.orderBy(PERIOD, BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        return index.select(PERIOD, BLOCK, "lo", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))

    def incident(self, incident_id: str) -> DataFrame:
        """F4 (zero rows when absent): the index tells the one block the number lies in, nothing is sorted or numbered."""
        number = incident_id.rsplit("-", 1)[-1]
        position = int(number) if number.isdigit() else -1
        firsts = self._firsts(self.index().filter("rows > 0")).withColumn("at", F.lit(position) - F.col("first"))
        place = firsts.join(self.index().select(PERIOD, BLOCK, "rows"), [PERIOD, BLOCK])
        place = place.filter("at >= 0 AND at < rows").first()  # one row of the index
        if place is None:
            return self.silver([])
        run = self.stored([place[PERIOD]]).filter(
            (F.col(BLOCK) == place[BLOCK]) & (F.col(ROW) == place["lo"] + place["at"])
        )
        named = run.withColumn("incident_id", incident_id_expr(F.lit(position))).drop(PERIOD, BLOCK, ROW)
        return load_incident(named, incident_id)

    def latest(self) -> dt.datetime | None:
        """D1 from the index."""
        return self.index().agg(F.max("latest")).first()[0]  # one value

    def panes(self, since: dt.date) -> DataFrame:
        return self._read("panes", self.panes_schema, [p for p in self._since(since) if p != NO_TIME])

    def _since(self, day: dt.date) -> list[str]:
        first = _period_text(day, self.grain)
        return sorted(p for p in self.places if p >= first)

    def health(self, days: int = 7, ordered: bool = True) -> DataFrame:
        """D1-D9 from the panes of the window and the runs of the day its start lies in."""
        latest = self.latest()
        cutoff, first = window_start(latest or dt.datetime(1970, 1, 1), days)
        edge = _period_text(first, self.grain)
        cut = self.stored([edge]).filter(F.col("event_ts") >= F.lit(cutoff))
        return health_from_panes(self.panes(first), cut, days, latest or cutoff, ordered)


def _with_period(fields: list[T.StructField]) -> T.StructType:
    return T.StructType([*fields, T.StructField(PERIOD, T.StringType())])


def _period_text(day: dt.date, grain: str) -> str:
    return (day.replace(day=1) if grain == "month" else day).isoformat()


def _log(base: str) -> str:
    return f"{base}/_commits"


def open_timeline(spark: SparkSession, base: str, version: int | None = None) -> Timeline:
    """The newest version, or the one named; version 0 is the empty table before the first commit."""
    base = base.rstrip("/")
    if version is None:
        version, content = newest(spark, _log(base))
    else:
        content = at_version(spark, _log(base), version) if version else {}
    schemas = [T.StructType.fromJson(content[k]) if content else None for k in ("schema", "panes_schema")]
    line = Timeline(spark, base, version, content.get("grain", "day"), content.get("index"), *schemas, {})
    if content:
        # one row a period
        line.places = {r[0]: r[1] for r in line.index().select(PERIOD, "batch").distinct().collect()}
    return line


def add_runs(spark: SparkSession, base: str, silver: DataFrame, grain: str = "day", attempts: int = 10) -> Timeline:
    """Add scored runs (``score_silver`` rows) to the timeline under ``base``; returns the new version.

    ``grain`` (``day`` or ``month``) is fixed by the first call.
    """
    if grain not in ("day", "month"):
        raise ValueError(f"grain is day or month, not {grain!r}")
    base = base.rstrip("/")
    # the new runs are computed once, whatever follows
    staged_path = f"{base}/_staged/{uuid.uuid4().hex}"
    period = F.coalesce(F.date_format(F.date_trunc(grain, "event_ts"), "yyyy-MM-dd"), F.lit(NO_TIME))
    silver.withColumn(PERIOD, period).write.parquet(staged_path)
    staged = spark.read.schema(_with_period(silver.schema.fields)).parquet(staged_path)
    # one value a period
    touched = sorted(r[0] for r in staged.select(PERIOD).distinct().collect())
    for _ in range(attempts):
        now = open_timeline(spark, base)
        if now.version and now.grain != grain:
            raise ValueError(f"the timeline under {base} is kept by {now.grain}")
        if now.version and [f.name for f in silver.schema.fields] != [f.name for f in now.schema.fields if f.name not in (BLOCK, ROW)]:
            raise ValueError("the runs do not have the columns of the timeline")
        content = _write_version(now, staged, touched, grain, silver.schema)
        if commit(spark, _log(base), now.version + 1, content):
            return open_timeline(spark, base, now.version + 1)
    raise RuntimeError(f"{attempts} other writers came first under {base}")


def _write_version(now: Timeline, staged: DataFrame, touched: list[str], grain: str, schema: T.StructType) -> dict:
    spark, base, batch = now.spark, now.base, uuid.uuid4().hex
    rows = staged
    if now.version:
        rows = now.stored(touched).drop(BLOCK, ROW).unionByName(staged)
    # periods follow event order, so that rows sorted by them first are in that order and need no second sort to be written
    numbered = number_rows(rows, incident_order(), sort_partitions(rows.count()), first=[F.col(PERIOD).asc()])
    runs_path = f"{base}/runs/batch={batch}"
    # rows come in event order, so a task writes few folders
    numbered.write.partitionBy(PERIOD).parquet(runs_path)
    stored_schema = T.StructType([*schema.fields, T.StructField(BLOCK, T.IntegerType()), T.StructField(ROW, T.LongType())])
    written = spark.read.schema(_with_period(stored_schema.fields)).parquet(runs_path)
    panes = daily_panes(written)
    by_period = F.date_format(F.date_trunc(grain, DAY), "yyyy-MM-dd")
    panes.withColumn(PERIOD, by_period).repartitionByRange(PERIOD).write.partitionBy(PERIOD).parquet(f"{base}/panes/batch={batch}")
    new = written.groupBy(PERIOD, BLOCK).agg(
        F.min(ROW).alias("lo"), F.count(F.lit(1)).alias("rows"), F.max("event_ts").alias("latest")
    )
    kept = now.index().filter(~F.col(PERIOD).isin(touched)) if touched else now.index()
    columns = [PERIOD, "batch", BLOCK, "lo", "rows", "latest"]
    index_path = f"{base}/index/{batch}"
    kept.select(*columns).unionByName(new.withColumn("batch", F.lit(batch)).select(*columns)).coalesce(1).write.parquet(index_path)
    return {"grain": grain, "index": index_path, "schema": stored_schema.jsonValue(), "panes_schema": panes.schema.jsonValue()}
