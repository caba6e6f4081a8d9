import csv
import io
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from fleetlake.session import scratch_path
from fleetlake.sources.csv_records import byte_ranges, csv_lines, csv_multiline_text, csv_records
from fleetlake.sources.files import csv_scan, write_csv
from tests.conftest import SF_SMALL

OPTIONS = {"escape": '"', "multiLine": "true"}
PIECES = ["\n", '"', '""', ",", "a", " b ", "\r\n", "é😀", "", "x" * 30, '","', '"\n"']


@pytest.fixture
def small_ranges(spark):
    """Byte ranges of some hundred bytes, so that records are cut everywhere."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def _file(data: bytes) -> str:
    path = os.path.join(tempfile.mkdtemp(prefix="fl-csv-"), "data.csv")
    with open(path, "wb") as f:
        f.write(data)
    return path


def _random_table(rng, rows):
    return [["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 6))) for _ in range(3)] for _ in range(rows)]


def _csv(rows, end, quoting=csv.QUOTE_MINIMAL):
    out = io.StringIO()
    csv.writer(out, lineterminator=end, quoting=quoting).writerows(rows)
    return out.getvalue().encode()


def _norm(rows):
    return sorted(tuple(v or "" for v in r) for r in rows)


def test_random_files_match_a_sequential_parser(spark, small_ranges):
    rng = random.Random(4)
    for end, quoting in (("\n", csv.QUOTE_MINIMAL), ("\r\n", csv.QUOTE_ALL), ("\n", csv.QUOTE_ALL)):
        for broadcast in (1 << 20, 0):
            rows = [["id", *r] for r in _random_table(rng, 120)]
            rows = [[f"{i}", *r[1:]] for i, r in enumerate(rows)]
            path = _file(_csv([["k", "a b", "c.d", 'e"`']] + rows, end, quoting))
            names = spark.read.options(**OPTIONS, header=True).csv(path).columns
            assert names == ["k", "a b", "c.d", 'e"`']
            text = csv_multiline_text(spark, path, names, OPTIONS, broadcast)
            assert csv_lines(spark, path).select("start").distinct().count() > 20
            assert _norm(text.collect()) == _norm(rows)


def test_one_large_value_over_many_ranges(spark, small_ranges):
    value = "\n".join(f'line {i}, "quoted" {i % 3}' for i in range(400))
    rows = [["1", "short"], ["2", value], ["3", 'a "b"\nc']]
    path = _file(_csv([["i", "t"]] + rows, "\n"))
    back = csv_scan(spark, path, "i int, t string")
    assert sorted((str(r.i), r.t) for r in back.collect()) == [tuple(r) for r in rows]
    lines = csv_lines(spark, path)
    ranges = byte_ranges(lines)
    assert ranges.count() > 50
    assert csv_records(lines, ranges).count() == 4


def test_stray_quotes_do_not_open_values(spark, small_ranges):
    data = 'a,b\n5" pipe,x\n"6"" bolt\nlong",y\n7,"z" tail "q\n8," no "\n"9\n9","""\n"""\n'
    back = csv_scan(spark, _file(data.encode()), "a string, b string")
    plain = spark.read.options(**OPTIONS, header=True).csv(_file(data.encode()))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, plain.collect()))
    assert back.count() == 5


def test_bom_blank_lines_several_files_and_open_end(spark, small_ranges):
    folder = tempfile.mkdtemp(prefix="fl-csv-")
    for i, data in enumerate(['﻿a,b\n\n1,"x\n\ny"\n\n', 'a,b\n2,"p\nq"\n3,r', 'a,b\n4,"never closed\n5,s\n']):
        with open(f"{folder}/{i}.csv", "wb") as f:
            f.write(data.encode())
    rows = csv_scan(spark, folder, "a int, b string").collect()
    assert sorted(map(tuple, rows)) == [(1, "x\n\ny"), (2, "p\nq"), (3, "r"), (4, "never closed\n5,s")]


def test_files_without_line_breaks_take_the_plain_reader(spark):
    path = _file(b'a,b\n1,"x, y"\n2,\n')
    assert csv_multiline_text(spark, path, ["a", "b"], OPTIONS) is None
    assert sorted(map(tuple, csv_scan(spark, path).collect())) == [(1, "x, y"), (2, None)]
    assert csv_scan(spark, _file(b"a,b\n")).count() == 0


def test_one_large_file_is_many_tasks(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    path = scratch_path(spark, "csv-one") + "/documents.csv"
    write_csv(docs.coalesce(1), path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 14))
    try:
        lines = csv_lines(spark, path)
        assert lines.select("file").distinct().count() == 1
        assert lines.rdd.getNumPartitions() > 20
        back = csv_scan(spark, path, docs.schema)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, docs.collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_range_unknown_to_the_first_pass_stops_the_job(spark):
    path = _file(b'a,b\n1,"x\ny"\n')
    lines = csv_lines(spark, path)
    other = byte_ranges(lines).withColumn("size", F.col("size") + 1)
    with pytest.raises(Exception, match="split differently"):
        csv_records(lines, other).collect()


def test_records_of_long_lines_leave_in_pieces():
    """A batch of lines has any length; a task makes records of some MB of it at a time."""
    import pyarrow as pa

    from fleetlake.sources.csv_records import _PIECE_BYTES, _assemble, _pieces

    class Lines:  # what _assemble needs of a DataFrame
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    n, line = 60, "x" * 300_000
    ends = [i % 3 == 0 for i in range(n)]  # every third line goes on
    columns = [[7] * n, [0] * n, [9] * n, [False] * n, [True] * n, ends, ends, [f"{i}{line}" for i in range(n)]]
    names = ["file", "start", "size", "entry", "top", "closed", "open", "value"]
    out = list(_assemble(Lines())(iter([pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)])))
    assert len(out) > 3 and max(b.nbytes for b in out) < 2 * _PIECE_BYTES
    records = [r for b in out for r in b.column(5).to_pylist()]
    expected = [f"{i}{line}\n{i + 1}{line}" if i % 3 == 0 else f"{i}{line}" for i in range(n) if i % 3 != 1]
    assert records == expected
    import numpy as np

    assert list(_pieces(np.array([9, 1, 1, 3, 1]), 4)) == [(0, 1), (1, 3), (3, 5)] and list(_pieces(np.array([]), 4)) == []
