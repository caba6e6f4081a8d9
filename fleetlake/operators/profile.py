"""Single-pass dataset profile.

The original runs one Spark job per column to count nulls, plus a count.
Here every count is one aggregate over one scan (partial aggregation per
task, a single-row final merge), then unpivoted in the same plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlake.functions.fixed_values import PROFILE_SAMPLE_ROWS

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def is_missing(field: T.StructField) -> Column:
    """Null, or NaN for floating columns (pandas counts both as missing)."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def numeric_columns(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if isinstance(f.dataType, NUMERIC)]


def categorical_columns(schema: T.StructType, source: str = "parquet") -> list[str]:
    """Text and boolean columns; dates too when the source is CSV (pandas
    leaves CSV dates as text)."""
    kinds: tuple = (T.StringType, T.BooleanType)
    if source == "csv":
        kinds = kinds + (T.DateType, T.TimestampType, T.TimestampNTZType)
    return [f.name for f in schema.fields if isinstance(f.dataType, kinds)]


def column_kind(field: T.StructField, source: str = "parquet") -> str:
    if field.name in numeric_columns(T.StructType([field])):
        return "numeric"
    if field.name in categorical_columns(T.StructType([field]), source):
        return "categorical"
    return "other"


def column_features(df: DataFrame) -> DataFrame:
    """(column_name, spark_dtype, missing_count, row_count), one scan."""
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("_n")] + [
        F.count_if(is_missing(f)).alias(f"_m{i}") for i, f in enumerate(fields)
    ]
    row = df.agg(*aggs)
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("ordinal"),
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("spark_dtype"),
                F.col(f"_m{i}").alias("missing_count"),
            )
            for i, f in enumerate(fields)
        ]
    )
    return (
        row.select(F.col("_n").alias("row_count"), F.inline(entries))
        .select("ordinal", "column_name", "spark_dtype", "missing_count", "row_count")
    )


def _json_ready(df: DataFrame) -> DataFrame:
    """NaN -> null, timestamps as ISO text (microseconds only if present)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.when(F.isnan(c), F.lit(None).cast(f.dataType)).otherwise(c)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            base = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
            frac = F.date_format(c, "SSSSSS")
            c = F.when(frac == "000000", base).otherwise(F.concat(base, F.lit("."), frac))
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def sample_records(df: DataFrame, order_by: list[str] | None = None, n: int = PROFILE_SAMPLE_ROWS) -> DataFrame:
    """The first n rows (in an explicit order) as JSON-safe records,
    numbered from 1. The window runs over the n-row top-k result only."""
    order = [F.col(f"`{c}`").asc_nulls_last() for c in (order_by or df.columns)]
    head = df.orderBy(*order).limit(n)
    numbered = head.withColumn("_fl_i", F.row_number().over(Window.orderBy(*order)))
    ready = _json_ready(numbered)
    fields = [F.col(f"`{c}`") for c in ready.columns if c != "_fl_i"]
    record = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return ready.select(F.col("_fl_i").cast("bigint").alias("sample_index"), record.alias("record"))


def profile_summary(
    df: DataFrame, filename: str, order_by: list[str] | None = None, source: str = "parquet"
) -> DataFrame:
    """One profile row. Counts come from the single ``column_features``
    scan; names and kinds are schema metadata; the sample is a top-n."""
    feats = column_features(df)
    names = df.columns
    num = numeric_columns(df.schema)
    cat = categorical_columns(df.schema, source)
    missing = feats.agg(
        F.first("row_count").alias("rows"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("column_name", "missing_count")))).alias(
            "missing_values"
        ),
    )
    recs = sample_records(df, order_by).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("sample_index", "record"))), lambda x: x["record"]
        ).alias("_recs")
    )
    sample_json = recs.select(F.concat(F.lit("["), F.array_join("_recs", ","), F.lit("]"))).scalar()
    lit_arr = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    return missing.select(
        F.lit(filename).alias("filename"),
        F.coalesce(F.col("rows"), F.lit(0)).alias("rows"),
        F.lit(len(names)).alias("columns"),
        lit_arr(names).alias("column_names"),
        F.create_map(*[x for f in df.schema.fields for x in (F.lit(f.name), F.lit(f.dataType.simpleString()))]).alias(
            "dtypes"
        ),
        lit_arr(num).alias("numeric_columns"),
        lit_arr(cat).alias("categorical_columns"),
        "missing_values",
        sample_json.alias("sample_rows"),
    )
