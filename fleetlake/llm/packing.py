"""Bounded-space online packing of token ids into windows.

A task keeps at most ``open_windows`` windows open. A document's ids fill whole
windows first; the rest goes to the open window that it fills best. When none
has room and all places are taken, the fullest is emitted: a gap of at least
``min_cut`` ids is filled with the head of the piece, a smaller one is padded.
Finally the windows still open are merged: those of ``merge_groups`` tasks at
a time meet in one group, are packed again by the same rule (largest piece
first, without cuts), and what is still open goes to the next round, until
one group is left. So no task sees more than ``merge_groups * open_windows``
windows.

Cases: null or empty text is the end id alone; repeated rows are packed as
rows of their own; an empty table gives no rows; a document of any length is
cut into whole windows and one rest.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlake.llm.bpe import load
from fleetlake.llm.common import importable, materialise, narrow, text_chunks

WINDOW = 2048
OPEN_WINDOWS = 64
MIN_CUT = 64
END_ID = 1
MERGE_GROUPS = 64

_PIECE = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


class OpenWindows:
    """At most ``limit`` windows with room, by free ids. Windows are lists of pieces; ``emit`` takes full ones."""

    def __init__(self, window: int, limit: int, emit):
        self.window, self.limit, self.emit = window, limit, emit
        self.free: list[tuple[int, int]] = []  # (free ids, window number), sorted
        self.pieces: dict[int, list] = {}
        self.count = 0

    def _close(self, at: int) -> None:
        _, number = self.free.pop(at)
        self.emit(number, self.pieces.pop(number))

    def place(self, size: int, piece, cut=None) -> None:
        """``piece`` goes to the best fit; ``cut(piece, n)`` gives its first n ids and the rest."""
        while size:
            at = bisect_left(self.free, (size, -1))
            if at < len(self.free):
                free, number = self.free.pop(at)
            elif len(self.free) < self.limit:
                free, number = self.window, self.count
                self.count += 1
                self.pieces[number] = []
            else:
                room, number = self.free[0]
                if cut is None or room < cut.least:
                    self._close(0)
                    continue
                head, piece = cut(piece, room)
                self.pieces[number].append((self.window - room, head))
                self.free[0] = (0, number)
                self._close(0)
                size -= room
                continue
            self.pieces[number].append((self.window - free, piece))
            insort(self.free, (free - size, number))
            if free == size:
                self._close(0)
            return


class _Cut:
    def __init__(self, least: int):
        self.least = least

    def __call__(self, piece, n: int):
        row, start, ids = piece
        return (row, start, ids[:n]), (row, start + n, ids[n:])


def pack_partitions(
    docs: DataFrame, tokenizer: str, window: int, open_windows: int, min_cut: int, end_id: int
) -> DataFrame:
    """Pieces of each task's windows; ``closed`` is false for those of windows still open at the task's end."""

    def run(batches):
        bpe, part = load(tokenizer), TaskContext.get().partitionId()
        rows: list[tuple] = []

        def emit(number, pieces, closed=True):
            for offset, ((doc_id, total), start, ids) in pieces:
                rows.append(
                    (doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, (part << 32) + number, offset, closed)
                )

        opened = OpenWindows(window, open_windows, emit)
        cut = _Cut(min_cut)
        end = np.array([end_id], "<u4")
        for batch, texts in text_chunks(batches):
            encoded = bpe.encode([t.decode() for t in texts])
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded, strict=True):
                ids = np.append(ids, end).astype("<u4")
                whole = len(ids) // window * window
                for start in range(0, whole, window):
                    number, opened.count = opened.count, opened.count + 1
                    emit(number, [(0, ((doc_id, len(ids)), start, ids[start : start + window]))])
                if whole < len(ids):
                    opened.place(len(ids) - whole, ((doc_id, len(ids)), whole, ids[whole:]), cut)
            yield _batch(rows, schema)
            rows.clear()
        for number, pieces in opened.pieces.items():
            emit(number, pieces, closed=False)
        yield _batch(rows, schema)

    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "closed"]
    types = [_arrow(docs), *[pa.int64()] * 6, pa.bool_()]
    schema = pa.schema(list(zip(names, types, strict=True)))
    return narrow(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, {_PIECE}, closed boolean")


def _arrow(docs: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema["doc_id"].dataType)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema
    )


def merge_open(open_pieces: DataFrame, window: int, open_windows: int, last: bool, base: int) -> DataFrame:
    """Pack the pieces of each ``group`` again, largest first; in the last round every window is closed."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "sequence_id", "offset"], ascending=[False, True, True])
        group = int(frame["group"].iloc[0])
        sizes = frame["length"].tolist()
        number_of, offset_of, closed_of = [0] * len(sizes), [0] * len(sizes), [True] * len(sizes)

        def emit(number, pieces, closed=True):
            for offset, i in pieces:
                number_of[i], offset_of[i], closed_of[i] = number, offset, closed

        # the group is bounded, so all its windows may stay open until every piece is placed
        opened = OpenWindows(window, len(sizes), emit)
        for i, size in enumerate(sizes):
            opened.place(size, i)
        fullest = sorted(opened.free)
        for _, number in fullest if last else fullest[: max(0, len(fullest) - open_windows)]:
            emit(number, opened.pieces.pop(number))
        for number, pieces in opened.pieces.items():
            emit(number, pieces, closed=False)
        frame["sequence_id"] = [base + (group << 32) + n for n in number_of]
        frame["offset"], frame["closed"] = offset_of, closed_of
        return frame

    return open_pieces.groupBy("group").applyInPandas(run, open_pieces.schema)


def pack(
    docs: DataFrame,
    tokenizer: str,
    window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
    min_cut: int = MIN_CUT,
    end_id: int = END_ID,
    merge_groups: int = MERGE_GROUPS,
) -> DataFrame:
    """Pieces: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``."""
    importable(docs.sparkSession)
    packed = materialise(pack_partitions(docs, tokenizer, window, open_windows, min_cut, end_id), "packed")
    done = [packed.filter("closed")]
    group = F.shiftright("sequence_id", 32)  # the task that opened the window
    left, tasks = packed.filter("NOT closed"), packed.agg(F.max(group)).first()[0]
    tasks = 0 if tasks is None else tasks + 1
    level = 0
    while tasks:
        level += 1
        groups = -(-tasks // merge_groups)
        number = F.floor(F.shiftright("sequence_id", 32).bitwiseAND(F.lit((1 << 24) - 1)) / F.lit(merge_groups))
        left = left.withColumn("group", number.cast("bigint"))
        merged = materialise(
            merge_open(left, window, open_windows, groups == 1, level << 56).drop("group"), "packed-merge"
        )
        done.append(merged.filter("closed"))
        left, tasks = merged.filter("NOT closed"), groups if groups > 1 else 0
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("closed")
