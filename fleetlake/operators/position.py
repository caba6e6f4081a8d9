"""Global row position in a total order, without a single-task window.

``row_number() OVER (ORDER BY ...)`` with no partition runs in one task. At
scale we range-partition on the sort key instead (Spark samples the key, so a
hot value is split across partitions by the later key columns), number rows
inside each partition, and add the row count of all earlier partitions. The
per-partition counts are one row per partition, a size bound we choose, so
broadcasting them is safe.

The numbering must be materialised before counting, so that the counts and
the numbers come from the same partitioning even if a stage is retried (the
range bounds come from a sample, and a second run would sample again). Two
ways:

* ``with_global_position`` checkpoints the numbered rows (reliable checkpoint
  in the cluster's shared checkpoint folder);
* a job that writes the rows anyway (bronze, B4 "sort and renumber") stores
  ``number_rows`` output and later calls ``positions_from_numbered`` on the
  stored table, which saves one full materialisation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlake.session import ensure_checkpoint_dir

BLOCK = "row_block"  # range partition the row fell into
ROW = "row_in_block"  # increasing id inside the block (block << 33 | index)


#: Rows that one task sorts. Runs take up to 1 KB each in memory however small they are on disk, where many values repeat.
SORT_ROWS = 1 << 17


def sort_partitions(rows: int) -> int | None:
    """Partitions for sorting so many runs within a task's memory; None leaves a small number of rows to the session."""
    return -(-rows // SORT_ROWS) if rows > 2 * SORT_ROWS else None


def number_rows(
    df: DataFrame, order_by: list[Column], num_partitions: int | None = None, first: list[Column] | None = None
) -> DataFrame:
    """Range-partition and sort on ``order_by``; add the block and in-block ids.
    ``first`` are columns that follow that order, to sort by before it.

    Without ``num_partitions`` the range shuffle uses the session's partition
    count and AQE may coalesce neighbouring ranges up to its advisory size.
    Coalesced blocks are still contiguous key ranges in order, so the
    numbering stays exact and block sizes follow the data. AQE goes by
    compressed sizes, though, so that large tables should name a count
    (``sort_partitions``): a block that memory does not hold is spilled.
    """
    ranged = df.repartitionByRange(num_partitions, *order_by) if num_partitions else df.repartitionByRange(*order_by)
    return (
        ranged
        .sortWithinPartitions(*(first or []), *order_by)
        .withColumn(BLOCK, F.spark_partition_id())
        .withColumn(ROW, F.monotonically_increasing_id())
    )


def positions_from_numbered(numbered: DataFrame, name: str = "position", num_partitions: int | None = None) -> DataFrame:
    """``name`` = 0-based position, from MATERIALISED ``number_rows`` output.

    With the ``num_partitions`` that numbered the rows, each block is one task
    again: a shuffle that needs no sample, so nothing below it is computed twice.
    """
    counts = numbered.groupBy(BLOCK).agg(F.count(F.lit(1)).alias("_fl_cnt"))
    # the in-block id has 33 bits: a larger block would make positions collide,
    # so fail loudly (inside the plan, no extra job) instead of numbering wrongly
    counts = counts.withColumn(
        "_fl_cnt",
        F.when(
            F.col("_fl_cnt") >= F.lit(1 << 33),
            F.raise_error(F.lit("position block over 2^33 rows: use more partitions")),
        ).otherwise(F.col("_fl_cnt")),
    )
    offsets = counts.select(
        BLOCK,
        (F.sum("_fl_cnt").over(Window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1))).alias("_fl_off"),
    ).fillna(0, subset=["_fl_off"])
    # monotonically_increasing_id = partition index << 33 | row index in partition
    local = F.col(ROW) - F.shiftleft(F.col(BLOCK).cast("bigint"), 33)
    rows = numbered.repartitionById(num_partitions, F.col(BLOCK)) if num_partitions else numbered
    return (
        rows.join(F.broadcast(offsets), BLOCK)
        .withColumn(name, F.col("_fl_off") + local)
        .drop(BLOCK, ROW, "_fl_off")
    )


def with_global_position(
    df: DataFrame,
    order_by: list[Column],
    name: str = "position",
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``name`` = 0-based position of each row in ``order_by`` order.

    ``order_by`` must be a total order (end it with a unique key) for the
    positions to be deterministic.
    """
    ensure_checkpoint_dir(df.sparkSession)
    numbered = number_rows(df, order_by, num_partitions).checkpoint(eager=True)
    return positions_from_numbered(numbered, name)
