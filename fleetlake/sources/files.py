"""File sources and sinks.

* CSV scan: every column is read as text and the missing-value tokens are
  nulled in one ``select``. With a schema the text is converted to it and
  cells that do not convert can be listed (``csv_rejects``). Without one, each
  column's type comes from ONE aggregate of failed ``try_cast`` counts
  (bigint, double, boolean, date, timestamp, else string) -- a second scan,
  but never a per-column job. Line breaks in quoted values are looked for and
  kept; such a file is split over as many tasks as any other
  (``csv_records``). ``multi_line=False`` skips the look.
* Parquet: partitioned writes; reads return an empty typed frame when the
  path does not exist; versioned publish so a reader never sees a table
  half-replaced.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlake.functions.fixed_values import MISSING_TOKENS
from fleetlake.sources.csv_records import csv_multiline_text

# candidate types in the order they are tried
_TRY_TYPES = ["bigint", "double", "boolean", "date", "timestamp_ntz"]
_DATE_ONLY = r"^\d{4}-\d{2}-\d{2}$"
_BOOL_TEXT = ["true", "false"]
# text shapes accepted as numbers (the cast alone is looser: with ANSI off it
# truncates "1.5" to a bigint, and it accepts Java suffixes such as "1d")
_INT_TEXT = r"^[+-]?[0-9]+$"
_FLOAT_TEXT = r"(?i)^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)(e[+-]?[0-9]+)?$|^[+-]?(inf|infinity)$"


def _q(name: str):
    return F.col(f"`{name}`")


def null_missing_tokens(df: DataFrame, tokens: list[str] = MISSING_TOKENS) -> DataFrame:
    """Text equal to a missing-value token becomes null (one projection)."""
    return df.select(*[F.when(_q(c).isin(tokens), F.lit(None)).otherwise(_q(c)).alias(c) for c in df.columns])


def _fits(c, t: str):
    """True when the (non-null) text value converts to type t."""
    if t == "boolean":
        return F.lower(c).isin(_BOOL_TEXT)
    if t == "date":
        return c.rlike(_DATE_ONLY) & c.try_cast("date").isNotNull()
    if t in ("tinyint", "smallint", "int", "bigint"):
        return F.trim(c).rlike(_INT_TEXT) & F.trim(c).try_cast(t).isNotNull()
    if t in ("float", "double"):
        return F.trim(c).rlike(_FLOAT_TEXT) & F.trim(c).try_cast(t).isNotNull()
    return c.try_cast(t).isNotNull()


def infer_types(text: DataFrame) -> dict[str, str]:
    """One aggregate: for every column and candidate type, how many non-null
    values fail to convert. The first type with no failures wins."""
    aggs = []
    for i, c in enumerate(text.columns):
        col = _q(c)
        aggs.append(F.count(col).alias(f"n{i}"))
        for t in _TRY_TYPES:
            aggs.append(F.count_if(col.isNotNull() & ~_fits(col, t)).alias(f"b{i}_{t}"))
    row = text.agg(*aggs).first()  # one row of counts: bounded by the column count
    types = {}
    for i, c in enumerate(text.columns):
        if row[f"n{i}"] == 0:
            types[c] = "double"  # an all-missing column reads as float in pandas
            continue
        types[c] = next((t for t in _TRY_TYPES if row[f"b{i}_{t}"] == 0), "string")
    return types


def _convert(c, t: str):
    if t == "string":
        return c
    if t == "boolean":
        return F.when(F.lower(c).isin(_BOOL_TEXT), F.lower(c) == F.lit("true"))
    numeric = t in ("tinyint", "smallint", "int", "bigint", "float", "double")
    value = (F.trim(c) if numeric else c).try_cast(t)
    return F.when(_fits(c, t), value) if numeric else value


def _csv_text(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    options = {"escape": '"', "multiLine": "true"}
    if multi_line:
        names = spark.read.options(**options, header=True).csv(path).columns
        text = csv_multiline_text(spark, path, names, options)
        if text is not None:
            return null_missing_tokens(text)
    return null_missing_tokens(spark.read.option("header", True).option("escape", '"').csv(path))


def _as_struct(schema: T.StructType | str) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def csv_scan(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = True
) -> DataFrame:
    """A1: CSV with a header, missing tokens as nulls. Typed by ``schema``
    (cells that do not convert are null, see ``csv_rejects``), else A1b."""
    text = _csv_text(spark, path, multi_line)
    if schema is not None:
        kinds = {f.name: f.dataType.simpleString() for f in _as_struct(schema).fields}
    else:
        kinds = infer_types(text)
    return text.select(*[_convert(_q(c), t).alias(c) for c, t in kinds.items()])


def csv_rejects(spark: SparkSession, path: str, schema: T.StructType | str, multi_line: bool = True) -> DataFrame:
    """``column``, ``rejected``: how many cells of each column had text that the schema's type does not hold."""
    text = _csv_text(spark, path, multi_line)
    fields = _as_struct(schema).fields
    counts = [
        F.struct(
            F.lit(f.name).alias("column"),
            F.count_if(_q(f.name).isNotNull() & _convert(_q(f.name), f.dataType.simpleString()).isNull()).alias("rejected"),
        )
        for f in fields
    ]
    return text.agg(F.array(*counts).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def write_csv(df: DataFrame, path: str) -> None:
    """A2: CSV with a header."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
        .csv(path)
    )


def write_parquet_dataset(
    df: DataFrame,
    path: str,
    partition_cols: list[str] | None = None,
    cluster_by: list[str] | None = None,
    lookup_by: list[str] | None = None,
    tasks: int | None = None,
    dealt: bool = False,
    finish: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """A3: partitioned parquet.

    Rows are range-partitioned on (partition columns, clustering keys) and
    sorted the same way. Each task then holds a contiguous key range, so it
    writes into few partition directories; a hot partition value is split
    across tasks by the clustering keys instead of landing in one task (a
    hash repartition on a 3-value column would use 3 tasks for the whole
    table); and files are sorted, so min/max statistics prune row groups.
    ``lookup_by`` columns get Bloom filters, so that a filter on one value
    skips the row groups that cannot hold it, whatever the order of the rows.
    ``tasks`` is the number of ranges; without it AQE chooses, by compressed sizes.
    Rows that are ``dealt`` to tasks of neighbouring rows already are only sorted.
    The ranges come from a sample, for which all columns are computed once more:
    ``finish`` adds those that the order does not need after the sort.
    """
    keys = [_q(c) for c in (partition_cols or []) + (cluster_by or [])]
    count = [tasks] if tasks else []
    out = df
    if keys:
        out = (df if dealt else df.repartitionByRange(*count, *keys)).sortWithinPartitions(*keys)
    if finish is not None:
        out = finish(out)
    writer = out.write.mode("overwrite")
    for c in lookup_by or []:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    if lookup_by:
        writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")
    if partition_cols:
        writer = writer.partitionBy(*partition_cols)
    writer.parquet(path)


def read_parquet_dataset(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A4: the table, or an empty frame of ``schema`` when the path is absent."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    try:
        return reader.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            if schema is None:
                return spark.createDataFrame([], T.StructType([]))
            return spark.createDataFrame([], schema)
        raise


def publish_version(
    df: DataFrame,
    base: str,
    version: str,
    partition_cols: list[str] | None = None,
    cluster_by: list[str] | None = None,
    lookup_by: list[str] | None = None,
    tasks: int | None = None,
    dealt: bool = False,
    finish: Callable[[DataFrame], DataFrame] | None = None,
) -> str:
    """Write a new immutable version directory; readers move to it only when
    the manifest names it (see ``manifest``). Never overwrites a path being read."""
    target = f"{base.rstrip('/')}/version={version}"
    write_parquet_dataset(df, target, partition_cols, cluster_by, lookup_by, tasks, dealt, finish)
    return target


def land_bronze(df: DataFrame, path: str) -> DataFrame:
    """A5: stamp ``_ingested_at`` and land the rows as parquet; returns the landed table."""
    df.withColumn("_ingested_at", F.current_timestamp()).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def read_dataset(spark: SparkSession, path: str, schema=None, multi_line: bool = True) -> DataFrame:
    """Choose the reader by file extension."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix in (".xlsx", ".xls"):
        raise ValueError("Excel files are not supported; save the sheet as CSV or parquet.")
    if suffix == ".csv":
        return csv_scan(spark, path, schema, multi_line)
    if suffix in (".json", ".jsonl"):
        return spark.read.schema(schema).json(path) if schema is not None else spark.read.json(path)
    return read_parquet_dataset(spark, path, schema)

