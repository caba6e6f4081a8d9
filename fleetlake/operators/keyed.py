"""Tables with one current row per id that are merged when read (H1, H5).

An upsert writes only its own rows, as one more segment, and a commit that
lists the segments in order. A reader merges the segments it is told of: per id
the row with the highest sequence, the later segment winning ties. Once there
are more than ``max_segments``, they are merged into one and the list becomes
short again. Rows are stored by a bucket of their id, so a lookup reads one
bucket of each segment.

Commits go to a log in which a version belongs to one writer
(``sources/commits``). Since segments merge in any number, a writer that lost
adds its segment to the winner's list and commits again; nothing is written
twice, and no update is lost. Segments that a merge replaced stay on storage
for readers that hold an older version.

Null ids are an id of their own; a null sequence is the lowest.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlake.operators.runlog import SEQ
from fleetlake.sources.commits import commit, newest

BUCKET, SEGMENT = "_bucket", "_segment"
BUCKETS = 16
MAX_SEGMENTS = 8


def _log(table: str) -> str:
    return f"{table}/_commits"


def _data(table: str) -> str:
    return f"{table}/segments"


def _bucket(key, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _latest(rows: DataFrame, key: str, order) -> DataFrame:
    """One row per id: the last by ``order``. A partial aggregate, so an id with a third of all rows is merged per task."""
    values = [c for c in rows.columns if c not in (key, SEGMENT)]
    found = rows.groupBy(key).agg(F.max_by(F.struct(*values), order).alias("_r"))
    return found.select(key, *[F.col(f"_r.{c}").alias(c) for c in values])


def _write_segment(rows: DataFrame, table: str, key: str, buckets: int) -> str:
    name = uuid.uuid4().hex
    placed = rows.withColumn(BUCKET, _bucket(key, buckets))
    # by bucket and id, so that a large bucket is several tasks and files
    placed.repartitionByRange(BUCKET, key).write.partitionBy(BUCKET).parquet(f"{_data(table)}/{SEGMENT}={name}")
    return name


def _read(spark: SparkSession, table: str, content: dict, schema: T.StructType, key: str, seq: str, one=None) -> DataFrame:
    segments = content.get("segments", [])
    if not segments:
        return spark.createDataFrame([], schema)
    stored = T.StructType([*schema.fields, T.StructField(SEGMENT, T.StringType()), T.StructField(BUCKET, T.IntegerType())])
    paths = [f"{_data(table)}/{SEGMENT}={s}" for s in segments]
    rows = spark.read.schema(stored).option("basePath", _data(table)).parquet(*paths)
    if one is not None:
        rows = rows.filter((F.col(BUCKET) == _bucket(one, content["buckets"])) & F.col(key).eqNullSafe(one))
    rows = rows.drop(BUCKET)
    if len(segments) > 1:
        places = F.create_map(*[x for i, s in enumerate(segments) for x in (F.lit(s), F.lit(i))])
        rows = _latest(rows, key, F.struct(F.col(seq), places[F.col(SEGMENT)]))
    return rows.select(*schema.fieldNames())


def _as_struct(schema: T.StructType | str) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def read_rows(spark: SparkSession, table: str, schema: T.StructType | str, key: str = "id", seq: str = SEQ) -> DataFrame:
    """The current row of every id (an empty frame before the first upsert)."""
    table = table.rstrip("/")
    return _read(spark, table, newest(spark, _log(table))[1], _as_struct(schema), key, seq)


def read_row(spark: SparkSession, table: str, schema: T.StructType | str, id_, key: str = "id", seq: str = SEQ) -> DataFrame:
    """The current row of one id (zero rows when absent)."""
    table, kind = table.rstrip("/"), _as_struct(schema)
    one = F.lit(id_).cast(kind[key].dataType)
    return _read(spark, table, newest(spark, _log(table))[1], kind, key, seq, one)


def _commit(spark: SparkSession, table: str, change) -> int:
    """Commit ``change(content)`` as the next version, again and again until no other writer comes first."""
    while True:
        version, content = newest(spark, _log(table))
        if commit(spark, _log(table), version + 1, change(content)):
            return version + 1


def upsert_rows(
    spark: SparkSession,
    table: str,
    updates: DataFrame,
    schema: T.StructType | str,
    key: str = "id",
    seq: str = SEQ,
    buckets: int = BUCKETS,
    max_segments: int = MAX_SEGMENTS,
) -> int:
    """Insert new ids, replace existing ones as a whole; returns the version. ``buckets`` counts for a new table only."""
    table, kind = table.rstrip("/"), _as_struct(schema)
    buckets = newest(spark, _log(table))[1].get("buckets", buckets)
    name = _write_segment(_latest(updates.select(*kind.fieldNames()), key, F.struct(seq)), table, key, buckets)
    lost = False

    def add(content):
        nonlocal lost
        # the first commit of the table decides; a segment placed otherwise is placed again
        lost = content.get("buckets", buckets) != buckets
        return content if lost else {"buckets": buckets, "segments": [*content.get("segments", []), name]}

    version = _commit(spark, table, add)
    if lost:
        return upsert_rows(spark, table, updates, schema, key, seq, buckets, max_segments)
    if len(newest(spark, _log(table))[1]["segments"]) > max_segments:
        version = compact(spark, table, schema, key, seq)
    return version


def compact(spark: SparkSession, table: str, schema: T.StructType | str, key: str = "id", seq: str = SEQ) -> int:
    """Merge all segments into one; segments that were added meanwhile stay behind it."""
    table = table.rstrip("/")
    _, content = newest(spark, _log(table))
    merged = content.get("segments", [])
    name = _write_segment(_read(spark, table, content, _as_struct(schema), key, seq), table, key, content.get("buckets", BUCKETS))

    def replace(now):
        segments = now.get("segments", [])
        if segments[: len(merged)] != merged:  # another merge came first; its result stands
            return now
        return {**now, "segments": [name, *segments[len(merged) :]]}

    return _commit(spark, table, replace)
