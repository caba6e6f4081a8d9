"""Serving records and the pipeline manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlake.functions.exprs import iso_seconds


def records_json(df: DataFrame) -> DataFrame:
    """One JSON record per row; timestamps as ``%Y-%m-%dT%H:%M:%S``,
    NaN and null as JSON null, every field present."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = iso_seconds(c)
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.when(F.isnan(c), F.lit(None).cast(f.dataType)).otherwise(c)
        cols.append(c.alias(f.name))
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("record"))


MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("started_at", T.StringType()),
        T.StructField("finished_at", T.StringType()),
        T.StructField("raw_rows", T.LongType()),
        T.StructField("feature_rows", T.LongType()),
        T.StructField("incident_count", T.LongType()),
        T.StructField("customer_count", T.LongType()),
        T.StructField("output_paths", T.MapType(T.StringType(), T.StringType())),
    ]
)


def manifest_row(
    spark: SparkSession,
    run_id: str,
    started_at: str,
    counts: dict[str, Column],
    output_paths: dict[str, str],
    finished_at: Column | None = None,
) -> DataFrame:
    """One row built from scalar-subquery counts (no collect)."""
    base = spark.range(1).select(
        F.lit(run_id).alias("run_id"),
        F.lit(started_at).alias("started_at"),
        (finished_at if finished_at is not None else F.lit(None).cast("string")).alias("finished_at"),
        *[counts[k].cast("bigint").alias(k) for k in ("raw_rows", "feature_rows", "incident_count", "customer_count")],
        F.create_map(*[x for k, v in output_paths.items() for x in (F.lit(k), F.lit(v))]).alias("output_paths"),
    )
    return base


def persist_manifest(manifest: DataFrame, path: str) -> None:
    """Append the run's manifest row: the log is append-only, so there is no
    moment without a manifest (an overwrite would delete first)."""
    manifest.coalesce(1).write.mode("append").json(path)


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The newest manifest row, or an empty frame when none was written yet."""
    try:
        log = spark.read.schema(MANIFEST_SCHEMA).json(path)
    except Exception:  # noqa: BLE001 - a missing manifest reads as empty
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    return log.orderBy(F.col("finished_at").desc_nulls_last(), F.col("run_id").desc()).limit(1)
