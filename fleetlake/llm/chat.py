"""Chat formatting with a black-box template, and where each turn's text landed.

A template is a function from a list of turns to one text; nothing is known of
its inside. What a turn adds is found by rendering successive prefixes of the
conversation: the output for turns 0..i continues the output for turns 0..i-1,
and what comes after is turn i's piece. Where the text itself lies in its piece
is found by rendering the same prefix twice more with two one-letter texts in
place of turn i's: what both share in front is the header, behind the footer.
If an output does not continue the one before it, the template has rewritten
history; the first turn it changed is reported.

Prefixes are rendered inside windows: the turns numbered ``window * k`` up to
``window * (k + 1) - 1`` with the ``context`` turn numbers before them in
front. So a conversation of any length is split over many tasks, a prefix never
has more than ``window + context`` turns, and the work grows with the turns.
Within the first window prefixes are whole conversations. Beyond it a template
may look back ``context`` turns (and see no other), which is the operator's one
demand on it. Rows that share a turn number beyond the size of a window are cut
into further windows as they stream by, in order.

Texts are shuffled once, by conversation and window, and sorted there; a task
holds one window of texts.

Cases: null texts and roles are empty; ties of the turn number are ordered by
role, then text, so equal rows are turns of their own and can be swapped; null
turn numbers come first and negative ones before 0; a null conversation id is a
conversation of its own; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlake.llm.common import importable, narrow

WINDOW = 32
CONTEXT = 4
PROBES = ("x", "y")

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

START, END = "<|im_start|>", "<|im_end|>"
_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.DOTALL)


def escape(text: str) -> str:
    """No ``<|`` is left: one backslash more between the two, also where there are some already."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(turns: list[Turn]) -> str:
    """The template of the query: marks around every turn, control strings inside texts escaped."""
    return "".join(f"{START}{_escape_role(role)}\n{escape(text)}{END}\n" for role, text in turns)


def parse(formatted: str) -> list[Turn]:
    """The turns of an output of ``render``; raises if anything lies between or after them."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        turns.append((_unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn at character {at} of a formatted text")
    return turns


def _first_difference(a: str, b: str) -> int:
    """Characters that a and b share in front, by halving."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _shared_end(a: str, b: str) -> int:
    return _first_difference(a[::-1], b[::-1])


def locate(template: Template, before: list[Turn], turns: list[Turn]) -> Iterator[tuple[str, int, int, int | None]]:
    """For each of ``turns``: its piece of the output, where its text starts and ends in it, and the first turn rewritten.

    Turns are counted from the first of ``before``. The piece of a turn that
    rewrote history is what follows the part that stayed. Start and end are
    (-1, -1) where a template does not show the text as one stretch between a
    header and a footer, for instance because it leaves the turn out.
    """
    output, ends = "", [0]
    for i in range(len(before)):
        output = template(before[: i + 1])
        ends.append(len(output))
    if not before:
        output = template([])
        ends = [len(output)]
    for i, (role, text) in enumerate(turns, len(before)):
        prefix = before + turns[: i - len(before)]
        now = template([*prefix, (role, text)])
        rewritten = None
        stay = len(output)
        if not now.startswith(output):
            stay = _first_difference(output, now)
            rewritten = next(t for t, end in enumerate(ends[1:]) if end > stay)
            ends = [min(e, stay) for e in ends]
        piece = now[stay:]
        one, two = (template([*prefix, (role, p)])[stay:] for p in PROBES)
        head, foot = _first_difference(one, two), _shared_end(one, two)
        begin, end = head, len(piece) - foot
        shown = len(one) == len(two) == head + 1 + foot and begin <= end
        if not shown or piece[:begin] != one[:head] or piece[end:] != one[head + 1 :]:
            begin = end = -1
        yield piece, begin, end, rewritten
        output = now
        ends.append(len(now))


_SEGMENT = (
    "chunk bigint, part int, whole boolean, head string, turns array<struct<turn:bigint,loss:boolean,piece:string,"
    "text_start:bigint,text_end:bigint,rewrites:int>>"
)
_MARK, _BEFORE, _OWN = 0, 1, 2
_OUT_BYTES = 1 << 20


def _routed(rows: DataFrame, window: int, context: int) -> DataFrame:
    """Every turn in its window, the last ones also in the next, and a mark in each window of a split conversation."""
    inside = F.pmod("turn", F.lit(window))
    rows = narrow(rows, "conv_id", "turn", "role", "text").select(
        "conv_id",
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = rows.withColumn("chunk", F.expr(f"(turn - pmod(turn, {window})) div {window}"))
    to = [F.struct("chunk", F.lit(_OWN).alias("kind")), F.struct((F.col("chunk") + 1).alias("chunk"), F.lit(_BEFORE).alias("kind"))]
    # a copy for the window after, which drops it where it has no turns of its own
    routed = rows.withColumn("to", F.explode(F.when(inside >= window - context, F.array(*to)).otherwise(F.array(to[0]))))
    routed = routed.select("conv_id", "to.chunk", "to.kind", "turn", "role", "text", F.lit(False).alias("first"))

    pairs = rows.select("conv_id", "chunk").distinct()
    split = pairs.groupBy(F.col("conv_id").alias("c")).agg(
        F.count(F.lit(1)).alias("chunks"), F.min("chunk").alias("least"), F.max(F.col("chunk").isNull()).alias("open")
    )
    starts = F.when(F.col("open"), F.col("chunk").isNull()).otherwise(F.col("chunk") == F.col("least"))
    marks = pairs.join(split.filter("chunks > 1"), F.col("conv_id").eqNullSafe(F.col("c"))).select(
        "conv_id",
        "chunk",
        F.lit(_MARK).alias("kind"),
        F.lit(None).cast("bigint").alias("turn"),
        F.lit("").alias("role"),
        F.lit("").alias("text"),
        starts.alias("first"),
    )
    return routed.unionByName(marks)


def format_conversations(
    rows: DataFrame,
    template: Template = render,
    loss_roles: tuple[str, ...] = ("assistant",),
    window: int = WINDOW,
    context: int = CONTEXT,
) -> DataFrame:
    """One row for each segment (at most ``window`` turns) of each conversation; ``chunk`` and ``part`` order them.

    The formatted text of a segment is ``head`` (what the template gives for no
    turns; only in a conversation's first segment) and the pieces of ``turns``
    in order. In its piece a turn's text is ``text_start:text_end`` (code
    points; -1 where the template does not show it as one stretch), and it is
    trained on if ``loss`` is set. ``rewrites`` is null, or how many turns back
    the earliest turn lies whose formatted text this turn changed; such pieces
    follow what stayed and do not add up to the template's last output.
    ``whole`` segments are all of their conversation.
    """
    if not 0 <= context <= window:
        raise ValueError(f"a context of {context} turns does not fit windows of {window}")
    importable(rows.sparkSession)
    routed = _routed(rows, window, context)
    order = ["conv_id", "chunk", "kind", "turn", "role", "text"]
    kinds = dict(routed.dtypes)
    schema = f"conv_id {kinds['conv_id']}, {_SEGMENT}"
    arrow_turns = pa.list_(
        pa.struct(
            [
                ("turn", pa.int64()),
                ("loss", pa.bool_()),
                ("piece", pa.string()),
                ("text_start", pa.int64()),
                ("text_end", pa.int64()),
                ("rewrites", pa.int32()),
            ]
        )
    )

    def segment(before, own):
        out = []
        found = locate(template, before, [(role, text) for _, role, text in own])
        for i, ((turn, role, _), (piece, begin, end, changed)) in enumerate(zip(own, found, strict=True), len(before)):
            back = None if changed is None else i - changed
            out.append((turn, role in loss_roles, piece, begin, end, back))
        return out

    def segments(batches):
        """(conv_id, chunk, part, whole, head, turns), one window of turns in memory."""
        key, before, own, part, split, first = None, [], [], 0, False, True

        def flush():
            head = template([]) if first and part == 0 else ""
            return (*key, part, not split, head, segment(before, own))

        for batch in batches:
            for lo in range(0, batch.num_rows, 64):  # few texts at a time leave Arrow's buffers
                for conv, chunk, kind, turn, role, text, starts in zip(
                    *[c.to_pylist() for c in batch.slice(lo, 64).columns], strict=True
                ):
                    if key != (conv, chunk):
                        if own:
                            yield flush()
                        key, before, own, part, split, first = (conv, chunk), [], [], 0, False, True
                    if kind == _MARK:
                        split, first = True, starts
                    elif kind == _BEFORE:
                        before = [*before, (role, text)][-context:]
                    else:
                        if len(own) == window:
                            split = True
                            yield flush()
                            before, own, part = [(r, t) for _, r, t in own][-context:], [], part + 1
                        own.append((turn, role, text))
        if own:
            yield flush()

    def run(batches):
        names = ["conv_id", "chunk", "part", "whole", "head", "turns"]
        rows_, size, kind = [], 0, None

        def emit():
            types = [kind, pa.int64(), pa.int32(), pa.bool_(), pa.string(), arrow_turns]
            columns = list(zip(*rows_, strict=True))
            turns = [[dict(zip([f.name for f in arrow_turns.value_type], t, strict=True)) for t in x] for x in columns[5]]
            columns[5] = turns
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        def seen():
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(0).type
                yield batch

        for row in segments(seen()):
            rows_.append(row)
            size += 200 + sum(len(t[2]) for t in row[5])
            if size > _OUT_BYTES:
                yield emit()
                rows_, size = [], 0
        if rows_:
            yield emit()

    return routed.repartition("conv_id", "chunk").sortWithinPartitions(*order).mapInArrow(run, schema)


def read_back(
    segments: DataFrame, parser: Callable[[str], list[Turn]] = parse, plain: Callable[[str], str] = unescape
) -> DataFrame:
    """What a reader of the formatted conversations finds: digests of all turns and of all text under the loss mask.

    Segments are parsed where they are. A whole conversation's digests are
    taken there too. Of a conversation in several segments the parsed text
    moves on, compressed, and is hashed in order as it streams by, as SHA-256
    has no other way; no more than a segment of it is in memory.
    """
    importable(segments.sparkSession)
    kind = dict(segments.dtypes)["conv_id"]
    narrow_ = segments.select("conv_id", "chunk", "part", "whole", "head", "turns")

    def parsed(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                pieces = [t["piece"] for t in row["turns"]]
                formatted = row["head"] + "".join(pieces)
                turns = parser(formatted)
                told = "".join(f"{role}\n{text}\n" for role, text in turns).encode()
                learnt = "".join(
                    plain(t["piece"][t["text_start"] : t["text_end"]]) for t in row["turns"] if t["loss"]
                )
                both = (told, learnt.encode())
                final = [hashlib.sha256(x).hexdigest() if row["whole"] else None for x in both]
                frames = [None if row["whole"] else pack(x) for x in both]
                out.append(
                    (row["conv_id"], row["chunk"], row["part"], len(turns), len(learnt), len(formatted), *final, *frames)
                )
            columns = list(zip(*out, strict=True)) or [[]] * 10
            types = [batch.schema.field(0).type, pa.int64(), pa.int32(), *[pa.int64()] * 3, *[pa.string()] * 2, *[pa.binary()] * 2]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=_READ
            )

    def joined(batches):
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        unpack = zstandard.ZstdDecompressor().decompress
        key, state, sums, type_ = None, None, [0, 0, 0], None

        def done():
            digests = [s if isinstance(s, str) else s.hexdigest() for s in state]
            return (key[0], sums[0], digests[0], sums[1], digests[1], sums[2])

        def batch_of(rows):
            types = [type_, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        out = []
        for batch in batches:
            type_ = batch.schema.field(0).type
            for lo in range(0, batch.num_rows, 64):
                for row in batch.slice(lo, 64).to_pylist():
                    if key != (row["conv_id"],):
                        if key is not None:
                            out.append(done())
                        key, sums = (row["conv_id"],), [0, 0, 0]
                        state = [row["turns_sha"] or hashlib.sha256(), row["loss_sha"] or hashlib.sha256()]
                    for i, name in enumerate(("n_turns", "loss_chars", "formatted_chars")):
                        sums[i] += row[name]
                    for s, name in zip(state, ("turns_frame", "loss_frame"), strict=True):
                        if row[name] is not None:
                            s.update(unpack(row[name]))
            if len(out) > 4096:
                yield batch_of(out)
                out = []
        if key is not None:
            out.append(done())
            yield batch_of(out)

    read = narrow_.mapInArrow(
        parsed,
        f"conv_id {kind}, chunk bigint, part int, n_turns bigint, loss_chars bigint, formatted_chars bigint, "
        "turns_sha string, loss_sha string, turns_frame binary, loss_frame binary",
    )
    return (
        read.repartition("conv_id")
        .sortWithinPartitions("conv_id", "chunk", "part")
        .mapInArrow(
            joined,
            f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
        )
    )


_READ = [
    "conv_id",
    "chunk",
    "part",
    "n_turns",
    "loss_chars",
    "formatted_chars",
    "turns_sha",
    "loss_sha",
    "turns_frame",
    "loss_frame",
]
