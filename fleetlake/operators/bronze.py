"""Bronze: typed, dated and stamped raw events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlake.functions.exprs import utc_now_text


def _parsed_ts(col_name: str, dtype: T.DataType):
    c = F.col(col_name)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return c
    if isinstance(dtype, T.DateType):
        return c.cast("timestamp_ntz")
    # text such as 2026-04-24T09:13 (wall-clock time, no zone); unparseable text becomes null
    return c.cast("string").try_cast("timestamp_ntz")


def build_bronze(raw: DataFrame, stamp: bool = True) -> DataFrame:
    """B1 parse ``event_ts``; B2 ``partition_date`` as yyyy-MM-dd; B3 stamp
    ``ingested_at`` (UTC text, whole seconds); NaN metrics become null.

    B4 (order by event_ts) is not a separate sort here: a DataFrame has no
    row order to keep. The order is applied where it is observable -- the
    incident position in silver and the sorted file layout on write.
    """
    dtypes = dict((f.name, f.dataType) for f in raw.schema.fields)
    out = raw.withColumn("event_ts", _parsed_ts("event_ts", dtypes["event_ts"]))
    pd_type = dtypes.get("partition_date")
    if pd_type is None:
        pdate = F.to_date(F.col("event_ts"))
    elif isinstance(pd_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        pdate = F.col("partition_date")
    else:
        pdate = F.col("partition_date").cast("string").try_cast("timestamp_ntz")
    out = out.withColumn("partition_date", F.date_format(pdate, "yyyy-MM-dd"))
    # NaN -> null: Spark orders NaN above every number (NaN > 40 is true), where
    # pandas comparisons with NaN are false; null keeps the pandas meaning
    floats = [f.name for f in out.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    out = out.withColumns({c: F.when(F.isnan(F.col(c)), F.lit(None)).otherwise(F.col(c)) for c in floats})
    if stamp:
        out = out.withColumn("ingested_at", utc_now_text())
    return out
