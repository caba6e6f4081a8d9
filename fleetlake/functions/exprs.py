"""Column-expression helpers shared by every layer.

All of them are built-in Spark expressions, so they stay inside whole-stage
codegen; none of them is a Python UDF.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lit_d(value: float) -> Column:
    """A DOUBLE literal (a bare 0.65 in SQL text would be DECIMAL)."""
    return F.lit(float(value))


def clip(x, lower: float | None = None, upper: float | None = None) -> Column:
    """Null-preserving clip. ``greatest``/``least`` skip nulls, so they are not used."""
    x = _c(x)
    out = x
    if upper is not None:
        out = F.when(x > F.lit(upper), F.lit(upper)).otherwise(out)
    if lower is not None:
        out = F.when(x < F.lit(lower), F.lit(lower)).otherwise(out)
    return out


def r1(x) -> Column:
    """Round to one decimal, half-even on x*10 (the numpy ``round(1)`` rule)."""
    return F.rint(_c(x) * F.lit(10.0)) / F.lit(10.0)


def tenths(x) -> Column:
    """A one-decimal double as an exact integer count of tenths."""
    return F.rint(_c(x) * F.lit(10.0)).cast("bigint")


def exact_mean_tenths(x) -> Column:
    """Mean of one-decimal values, independent of partition order.

    Float sums depend on the order partitions are merged in; summing exact
    integer tenths does not. The result is the correctly rounded mean.
    """
    x = _c(x)
    return F.sum(tenths(x)).cast("double") / (F.count(x).cast("double") * F.lit(10.0))


def safe_div(num, den) -> Column:
    """pandas-style division under ANSI mode.

    null when either side is null, +/-Infinity for x/0 with x != 0, null for
    0/0 (pandas gives NaN there; NaN is kept out of the tables, see bronze).
    """
    num, den = _c(num), _c(den)
    n = num.cast("double")
    d = den.cast("double")
    return (
        F.when(n.isNull() | d.isNull(), F.lit(None).cast("double"))
        .when((d == 0) & (n > 0), F.lit(float("inf")))
        .when((d == 0) & (n < 0), F.lit(float("-inf")))
        .when(d == 0, F.lit(None).cast("double"))
        .otherwise(n / d)
    )


def lookup(mapping: Mapping, key) -> Column:
    """Literal map lookup, null for a missing or null key (no join needed)."""
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.create_map(*pairs)[_c(key)]


def spaced(x) -> Column:
    """``failure_category.replace('_', ' ')``."""
    return F.replace(_c(x), F.lit("_"), F.lit(" "))


def num_text(x) -> Column:
    """Python-style text of a number (``28.0`` for a double, ``3`` for an int)."""
    return _c(x).cast("string")


def iso_seconds(x) -> Column:
    """``%Y-%m-%dT%H:%M:%S`` text of a timestamp."""
    return F.date_format(_c(x), "yyyy-MM-dd'T'HH:mm:ss")


def utc_now_text() -> Column:
    """Current UTC time as ``YYYY-MM-DDTHH:MM:SS+00:00`` (whole seconds)."""
    return F.concat(iso_seconds(F.convert_timezone(None, F.lit("UTC"), F.localtimestamp())), F.lit("+00:00"))


def nan_to_null(x) -> Column:
    """NaN as missing (pandas skips NaN in counts, means, min and max)."""
    x = _c(x)
    return F.when(F.isnan(x), F.lit(None)).otherwise(x)


def mean(x) -> Column:
    """Mean at full double precision; NaN counts as missing, as in pandas.

    Infinities give +inf, -inf, or NaN when both signs occur. Queries that are
    compared with another engine round it: sums of doubles depend on the order
    partitions are merged in, in the last bits.
    """
    return F.avg(nan_to_null(_c(x).cast("double")))
