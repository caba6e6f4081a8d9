"""Records of CSV files whose quoted values hold line breaks, split over many tasks.

A line break ends a record unless it lies in a quoted value, and whether it
does depends on all quotes before it. A task that starts in the middle of a
file does not see those. So the state is carried as a function instead: a line
that begins between records ends either between records or inside quotes, and
a line that begins inside quotes ends in one of the two as well. Such functions
compose, a byte range has one of its own, and the running composition over the
ranges of a file tells each range what it starts in.

1. Every line gets its two outcomes by built-in functions. A pass over these
   two bits composes them for each byte range that Spark's text reader makes.
2. The ranges (one small row each) are put in order per file; each learns its
   entry state.
3. A second pass joins lines to records in their own task. Only the first and
   last record of a range can be cut; those parts are grouped by record and
   joined, all others never move.

The rules for quotes are those of the CSV reader with ``escape`` set to a
quote: a quote opens a value only at its start, a doubled one inside quotes is
a quote, and after a closing quote everything up to the delimiter belongs to
the value. So stray quotes inside an unquoted value change nothing.

Both passes must see the same ranges. They are known by start and length, and
a line whose range the first pass has not seen stops the job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlake.session import scratch_path

#: A range is a row of some 30 bytes here; up to this many are broadcast, more are joined by a shuffle.
MAX_BROADCAST_RANGES = 1 << 20

_RANGE = ["file", "start", "size"]
_WHOLE, _CUT_AFTER, _CUT_BEFORE, _CUT_BOTH = 0, 1, 2, 3
_SINGLE_QUOTED = r'(^|,)"[^"]*+"'
#: Bytes of lines that a task makes records of at a time. A batch of lines goes by their number, which says nothing of their lengths.
_PIECE_BYTES = 1 << 22
_LEFT_OPEN = r'(?:^|,)"[^"]*+$'


def _ends_open(text: Column) -> Column:
    """Whether a line without doubled quotes that starts between records ends inside quotes."""
    return F.regexp_replace(text, _SINGLE_QUOTED, "$1_").rlike(_LEFT_OPEN)


def csv_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their byte range (``file``, ``start``, ``size``), order in it and two outcomes ``closed``, ``open``.

    ``closed`` tells whether the line ends inside quotes if it starts between
    records, ``open`` the same if it starts inside quotes.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    at_top = F.col("_metadata.file_block_start") == 0
    value = F.make_valid_utf8("value")
    lines = lines.select(
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_block_length").alias("size"),
        F.monotonically_increasing_id().alias("line"),
        F.when(at_top, F.regexp_replace(value, "^\ufeff", "")).otherwise(value).alias("value"),
    )
    single = F.replace(F.col("value"), F.lit('""'), F.lit(""))
    none = ~F.contains(F.col("value"), F.lit('"'))
    return lines.withColumns(
        {
            "closed": F.when(none, F.lit(False)).otherwise(_ends_open(single)),
            "open": F.when(none, F.lit(True)).otherwise(_ends_open(F.concat(F.lit('"'), single))),
        }
    )


def _stretches(keys: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Neighbouring rows with equal keys."""
    n = len(keys[0])
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    first = np.append(np.flatnonzero(new), n)
    yield from zip(first[:-1].tolist(), first[1:].tolist(), strict=True)


def _after(closed: np.ndarray, open_: np.ndarray, entry: bool) -> np.ndarray:
    """Whether each line ends inside quotes, when the first one starts in ``entry``."""
    # lines that end in one state whatever they start in; after the last of them only swaps count
    fixed = closed == open_
    swaps = np.cumsum(closed & ~open_)
    last = np.maximum.accumulate(np.where(fixed, np.arange(len(fixed)), -1))
    known = last >= 0
    base = np.where(known, closed[last], entry)
    return base ^ ((swaps - np.where(known, swaps[last], 0)) % 2 == 1)


def _pieces(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Neighbouring rows of up to ``most`` together; a larger row is alone."""
    a, total = 0, 0
    for b, size in enumerate(sizes.tolist()):
        if b > a and total + size > most:
            yield a, b
            a, total = b, 0
        total += size
    if a < len(sizes):
        yield a, len(sizes)


def byte_ranges(lines: DataFrame) -> DataFrame:
    """The two outcomes ``closed``, ``open`` of every byte range.

    ``breaks`` tells whether a line in it ends inside quotes if the range
    starts between records. Where no range has one, no value of any file has a
    line break.
    """

    def run(batches):
        key, value, breaks, done = None, (False, True), False, []
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            for a, b in _stretches(cols[:3]):
                here = tuple(int(c[a]) for c in cols[:3])
                if here != key:
                    if key is not None:
                        done.append((*key, *value, breaks))
                    key, value, breaks = here, (False, True), False
                after = [_after(cols[3][a:b], cols[4][a:b], v) for v in value]
                breaks = breaks or bool(after[0].any())
                value = tuple(bool(x[-1]) for x in after)
        if key is not None:
            done.append((*key, *value, breaks))
            names = [*_RANGE, "closed", "open", "breaks"]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=names)

    return lines.select(*_RANGE, "closed", "open").mapInArrow(
        run, "file bigint, start bigint, size bigint, closed boolean, open boolean, breaks boolean"
    )


def _entry_states(ranges: DataFrame) -> DataFrame:
    """``entry``: whether a range starts inside quotes; ``top``: whether it is the first of its file.

    One row a range, in windows by file: a file of 1 TB has some 8,000.
    """
    by_file = Window.partitionBy("file").orderBy("start")
    upto = by_file.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = by_file.rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.col("closed") == F.col("open")
    counted = ranges.withColumn("swaps", F.sum((F.col("closed") & ~F.col("open")).cast("int")).over(upto))
    found = counted.withColumns(
        {
            "last": F.last(F.when(fixed, F.struct("closed", "swaps")), True).over(before),
            "seen": F.coalesce(F.lag("swaps").over(by_file), F.lit(0)),
            "top": F.row_number().over(by_file) == 1,
        }
    )
    odd = F.pmod(F.col("seen") - F.coalesce(F.col("last.swaps"), F.lit(0)), F.lit(2)) == 1
    return found.select(*_RANGE, (F.coalesce(F.col("last.closed"), F.lit(False)) != odd).alias("entry"), "top")


def _assemble(lines: DataFrame) -> DataFrame:
    """``record`` with its byte range, how it is cut (``part``), and whether it is its file's first (``first``)."""

    def batch_of(rows):
        types = [pa.int64()] * 3 + [pa.int32(), pa.bool_(), pa.string()]
        columns = zip(*rows, strict=True)
        names = [*_RANGE, "part", "first", "record"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def run(batches):
        key, inside, pending, cut, first, out = None, False, [], False, False, []

        def leave():
            if pending:
                out.append((*key, _CUT_BOTH if cut else _CUT_AFTER, first, "\n".join(pending)))

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:7]]
            entry, top, closed, open_ = cols[3:]
            text = batch.column(7)
            for a, b in _stretches(cols[:3]):
                here = tuple(int(c[a]) for c in cols[:3])
                if here != key:
                    leave()
                    key, inside, pending, first = here, bool(entry[a]), [], bool(top[a])
                    cut = inside
                ends = _after(closed[a:b], open_[a:b], inside)
                inside = bool(ends[-1])
                for c, d in _pieces(pc.binary_length(text.slice(a, b - a)).to_numpy(zero_copy_only=False), _PIECE_BYTES):
                    for line, goes_on in zip(text.slice(a + c, d - c).to_pylist(), ends[c:d].tolist(), strict=True):
                        pending.append(line)
                        if not goes_on:
                            record = pending[0] if len(pending) == 1 else "\n".join(pending)
                            record = record.removesuffix("\r")
                            if record or cut:
                                out.append((*key, _CUT_BEFORE if cut else _WHOLE, first, record))
                                first = False
                            pending, cut = [], False
                    if out:
                        yield batch_of(out)
                        out = []
        leave()
        if out:
            yield batch_of(out)

    return lines.select(*_RANGE, "entry", "top", "closed", "open", "value").mapInArrow(
        run, "file bigint, start bigint, size bigint, part int, first boolean, record string"
    )


def csv_records(lines: DataFrame, ranges: DataFrame, broadcast_ranges: int = MAX_BROADCAST_RANGES) -> DataFrame:
    """``record`` (text) and ``first`` of every record of the files; blank records are left out."""
    spark = lines.sparkSession
    states = _entry_states(ranges)
    small = ranges.count() <= broadcast_ranges
    met = lines.join(F.broadcast(states) if small else states.hint("merge"), _RANGE, "left")
    lost = F.raise_error(F.lit("the files were split differently in two passes: read them again"))
    met = met.withColumn("entry", F.when(F.col("entry").isNull(), lost.cast("boolean")).otherwise(F.col("entry")))
    if not small:
        met = met.sortWithinPartitions(*_RANGE, "line")
    # written once: whole records, the parts of cut ones and any later pass over the table come from it
    path = scratch_path(spark, "csv-records")
    parts = _assemble(met)
    parts.write.parquet(path)
    parts = spark.read.schema(parts.schema).parquet(path)
    whole = parts.filter(F.col("part") == _WHOLE).select("first", "record")
    # in one range the part that ends a record comes before the one that begins the next
    begins = F.col("part") == _CUT_AFTER
    upto = Window.partitionBy("file").orderBy("start", begins).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = parts.filter(F.col("part") != _WHOLE)
    cut = cut.withColumn("owner", F.last(F.when(begins, F.col("start")), True).over(upto))
    pieces = F.array_sort(F.collect_list(F.struct("start", "record")))
    joined = cut.groupBy("file", "owner").agg(
        F.max("first").alias("first"), F.array_join(F.transform(pieces, lambda x: x["record"]), "\n").alias("record")
    )
    return whole.unionByName(joined.select("first", "record"))


def csv_multiline_text(
    spark: SparkSession, path: str, columns: list[str], options: dict[str, str], broadcast_ranges: int = MAX_BROADCAST_RANGES
) -> DataFrame | None:
    """All columns as text; None when no value of the files holds a line break, so that the plain reader will do."""
    lines = csv_lines(spark, path)
    stored = scratch_path(spark, "csv-ranges")
    found = byte_ranges(lines)
    found.write.parquet(stored)
    ranges = spark.read.schema(found.schema).parquet(stored)
    if ranges.filter("breaks").isEmpty():
        return None
    records = csv_records(lines, ranges, broadcast_ranges).filter(~F.col("first"))
    ddl = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
    return records.select(F.from_csv("record", ddl, options).alias("r")).select("r.*")
