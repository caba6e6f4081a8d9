"""Pattern matches with code-point positions, from built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,value:string,before:string>>"
#: Code points before a match that are kept with it.
CONTEXT = 80
#: Stands for an earlier match in ``before``.
MARK = "\ufffc"


def bound(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def prefix(values: Column, join, zero: Column) -> Column:
    """Running ``join`` (sum, maximum) of an array, in log2(size) rounds over it.

    Each round joins every element with the one 1, 2, 4, ... places before, so
    an array of n elements takes n log n steps; appending to an array in
    ``aggregate`` would copy it for every element.
    """
    rounds = F.slice(F.array(*[F.lit(k) for k in range(31)]), F.lit(1), F.length(F.bin(F.size(values) - 1)))

    def round_(acc: Column, k: Column) -> Column:
        shift = F.call_function("shiftleft", F.lit(1), k)
        earlier = F.concat(F.array_repeat(zero, shift), F.slice(acc, F.lit(1), F.size(acc) - shift))
        return F.zip_with(acc, earlier, join)

    return F.when(F.size(values) > 1, F.aggregate(rounds, values, round_)).otherwise(values)


def running_sum(values: Column) -> Column:
    return bound(values, lambda v: prefix(v, lambda x, y: x + y, F.lit(0).cast("bigint")))


def running_max(values: Column, zero: Column) -> Column:
    return bound(values, lambda v: prefix(v, lambda x, y: F.greatest(x, y), zero))


def counts_at(queries: Column, points: Column, inclusive: bool) -> Column:
    """For each of the ascending numbers ``queries``: how many ``points`` are below (``inclusive``: or equal)."""

    def event(side: bool, weight: int):
        return lambda x: F.struct(x.alias("at"), F.lit(side).alias("side"), F.lit(weight).cast("bigint").alias("w"))

    events = F.array_sort(
        F.concat(F.transform(points, event(not inclusive, 1)), F.transform(queries, event(inclusive, 0)))
    )

    def counted(e: Column) -> Column:
        sums = running_sum(F.transform(e, lambda x: x["w"]))
        both = F.zip_with(e, sums, lambda x, n: F.struct(x["w"].alias("w"), n.alias("n")))
        return F.transform(F.filter(both, lambda x: x["w"] == 0), lambda x: x["n"])

    return bound(events, counted)


def apart(spans: Column, others: Column) -> Column:
    """Those of ``spans`` (ascending, not overlapping) that no one of ``others`` overlaps."""
    # others that begin before a span's end, less those that end before its start
    begun = counts_at(F.transform(spans, lambda s: s["end"]), F.transform(others, lambda o: o["start"]), False)
    ended = counts_at(F.transform(spans, lambda s: s["start"]), F.transform(others, lambda o: o["end"]), True)
    touching = F.zip_with(begun, ended, lambda x, y: x - y)
    free = F.filter(F.zip_with(spans, touching, lambda s, n: F.struct(s.alias("s"), n.alias("n"))), lambda x: x["n"] == 0)
    return F.when((F.size(spans) > 0) & (F.size(others) > 0), F.transform(free, lambda x: x["s"])).otherwise(spans)


def outside(spans: Column, others: Column) -> Column:
    """Those of ``spans`` (start, end, kind) that lie wholly in no one of ``others``."""

    def event(mine: bool):
        reach = F.lit(-1) if mine else None
        return lambda s: F.struct(
            s["start"].alias("start"),
            F.lit(mine).alias("mine"),  # of equal starts the others come first
            (reach if mine else s["end"]).alias("reach"),
            s["end"].alias("end"),
            s["kind"].alias("kind"),
        )

    events = F.array_sort(F.concat(F.transform(others, event(False)), F.transform(spans, event(True))))

    def left(e: Column) -> Column:
        far = running_max(F.transform(e, lambda x: x["reach"]), F.lit(-1))
        both = F.zip_with(e, far, lambda x, r: F.struct(x.alias("x"), r.alias("far")))
        kept = F.filter(both, lambda y: y["x"]["mine"] & (y["far"] < y["x"]["end"]))
        return F.transform(
            kept, lambda y: F.struct(y["x"]["start"].alias("start"), y["x"]["end"].alias("end"), y["x"]["kind"].alias("kind"))
        )

    return F.when((F.size(spans) > 0) & (F.size(others) > 0), bound(events, left)).otherwise(spans)


#: Non-blank stretches between matches that ``CONTEXT`` code points can hold, with a mark each.
_REACH = CONTEXT // 2 + 1


def matches(text: Column, pattern: str, when: Column) -> Column:
    """All leftmost non-overlapping matches, ``end`` exclusive, with what stands ``before`` each.

    ``before`` are the last code points of the text in front of the match, each
    earlier match replaced by ``MARK``. Matches with no letter or digit between
    them share one mark, so what stands in front of a list is kept for all of it.

    The text between matches comes from ``split``, the matches from
    ``regexp_extract_all``; running sums of their lengths give the positions.
    The work is n log n in the matches of a text. ``when`` is a cheap condition
    that every text with a match meets.
    """
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def item(gap: Column, m: Column) -> Column:
        near = F.right(gap, F.lit(CONTEXT))
        # a gap longer than its kept end has room for words
        opens = (F.length(gap) > CONTEXT) | F.rlike(near, F.lit(r"[\p{L}\p{N}]"))
        return F.struct(F.length(gap).alias("gap"), m.alias("value"), near.alias("near"), opens.alias("opens"))

    items = F.filter(F.zip_with(between, found, item), lambda x: x["value"].isNotNull())

    def placed(b: Column) -> Column:
        # one running sum for two: lengths in the low 32 bits, matches that open a new stretch in the high ones
        steps = F.transform(
            b,
            lambda x, i: (x["gap"] + F.length(x["value"])).cast("bigint")
            + F.when((i == 0) | x["opens"], F.lit(1 << 32)).otherwise(F.lit(0)).cast("bigint"),
        )
        opening = F.transform(F.filter(b, lambda x, i: (i == 0) | x["opens"]), lambda x: x["near"])
        return bound(F.struct(running_sum(steps).alias("sums"), opening.alias("near")), lambda c: F.transform(b, one(c)))

    def one(c: Column):
        def span(x: Column, i: Column) -> Column:
            end = (c["sums"][i] % F.lit(1 << 32)).cast("int")
            start = end - F.length(x["value"])
            opened = (F.call_function("shiftright", c["sums"][i], F.lit(32))).cast("int")
            # stretches before this match; it has one itself if it opens one
            earlier = opened - F.when((i == 0) | x["opens"], 1).otherwise(0)
            first = F.greatest(F.lit(0), earlier - _REACH)
            marked = F.transform(F.slice(c["near"], first + 1, earlier - first), lambda t: F.concat(t, F.lit(MARK)))
            before = F.right(F.concat(F.array_join(marked, ""), x["near"]), F.lit(CONTEXT))
            return F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"), before.alias("before"))

        return span

    return F.coalesce(F.when(when, bound(items, placed)), F.array().cast(SPAN))


#: Code points of the blocks that a text is cut into, so that a piece is found without reading from the text's start.
BLOCK = 4096


def replaced(text: Column, spans: Column, put) -> Column:
    """``text`` with each of ``spans`` (ascending by start) replaced by ``put(span)``.

    A span that begins before the end of an earlier one only extends it. Linear
    in the text, and n log n in the spans.
    """
    blocks = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}+"), F.lit(0))

    def piece(b: Column, start: Column, end: Column) -> Column:
        first, last = (x.cast("int") for x in (F.floor(start / BLOCK), F.floor(end / BLOCK)))
        at = (start % BLOCK + 1).cast("int")
        head = F.substring(F.get(b, first), at, F.lit(BLOCK))
        middle = F.array_join(F.slice(b, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        tail = F.when(end % BLOCK > 0, F.substring(F.get(b, last), F.lit(1), (end % BLOCK).cast("int"))).otherwise(F.lit(""))
        inside = F.substring(F.get(b, first), at, (end - start).cast("int"))
        return F.when(start >= end, F.lit("")).when(first == last, inside).otherwise(F.concat(head, middle, tail))

    def rebuilt(c: Column) -> Column:
        def part(s: Column, i: Column) -> Column:
            at = F.when(i == 0, F.lit(0)).otherwise(F.get(c["ends"], i - 1))
            return F.when(s["start"] >= at, F.concat(piece(c["blocks"], at, s["start"]), put(s))).otherwise(F.lit(""))

        rest = piece(c["blocks"], F.element_at(c["ends"], -1), c["size"])
        return F.concat(F.array_join(F.transform(c["spans"], part), ""), rest)

    ends = running_max(F.transform(spans, lambda s: s["end"]), F.lit(0))
    parts = F.struct(spans.alias("spans"), ends.alias("ends"), blocks.alias("blocks"), F.length(text).alias("size"))
    return F.when(F.size(spans) > 0, bound(parts, rebuilt)).otherwise(text)


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` (null: empty) and ``text_key``; with ids that repeat, the key tells rows apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_key"))


def join_rows(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on ``doc_id`` (null ids included) and ``text_key``."""
    other = right.withColumnsRenamed({"doc_id": "right_id", "text_key": "right_key"})
    same = F.col("doc_id").eqNullSafe(F.col("right_id")) & (F.col("text_key") == F.col("right_key"))
    return left.join(other, same, how).drop("right_id", "right_key")


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined; ``spans`` has fields kind, start, end."""
    text = F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.array_join(text, ",")
