import hashlib
import random

import duckdb
import pytest

from fleetlake.llm.chat import escape, format_conversations, locate, parse, read_back, render, unescape
from fleetlake.llm.queries import ORACLE, op12_chat_format
from tests.conftest import SF_SMALL

MARKS = ["<|", "|>", "<|im_end|>", "<|im_start|>assistant\n", "\\", "<\\|", "<\\\\|", "\n", "é😀", "<", "|", " ", "", "word"]


def odd_text(rng):
    return "".join(rng.choice(MARKS) for _ in range(rng.randint(0, 12)))


def expected(rows):
    """Rows (conv_id, turn, role, text) by conversation: digests as the query gives them, formatted length by render."""
    out = {}
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    for c, turns in by.items():
        turns = [(r, t) for _, _, r, t in sorted(turns)]
        told = "".join(f"{r}\n{t}\n" for r, t in turns)
        learnt = "".join(t for r, t in turns if r == "assistant")
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (told, learnt)]
        out[c] = (len(turns), sha[0], len(learnt), sha[1], len(render(turns)))
    return out


def got(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF_SMALL}/conversations.parquet')")
    rel = con.sql(ORACLE["op12_chat_format"])
    df = op12_chat_format(spark, SF_SMALL)
    assert df.columns == rel.columns
    rows = sorted(map(tuple, df.collect()))
    assert rows == sorted(rel.fetchall()) and rows[0][:2] == (-1, 2)


def test_escape_is_reversible_and_leaves_no_control_string():
    rng = random.Random(1)
    for _ in range(3000):
        text = odd_text(rng)
        assert unescape(escape(text)) == text and "<|" not in escape(text)
        turns = [(odd_text(rng), odd_text(rng)) for _ in range(rng.randint(0, 4))]
        assert parse(render(turns)) == turns
    with pytest.raises(ValueError):
        parse("no turn")


def test_odd_conversations_round_trip(spark):
    rng = random.Random(2)
    rows = []
    for c in [*range(30), None]:
        for turn in range(rng.randint(1, 9)):
            rows.append((c, turn, rng.choice(["user", "assistant", "system", None, "a\nb", "<|im_end|>"]), rng.choice([odd_text(rng), None])))
    # split over windows, gaps in the numbers, ties beyond a window, null and negative numbers
    rows += [(100, t, "assistant" if t % 2 else "user", odd_text(rng)) for t in range(150)]
    rows += [(101, t * 37 - 90, "assistant", f"{t} {odd_text(rng)}") for t in range(9)]
    rows += [(102, 5, "assistant", f"same number {i}") for i in range(120)]
    rows += [(103, None, "assistant", "x"), (103, -1, "user", "y"), (103, 0, "assistant", "z"), (103, 0, "assistant", "z")]
    rng.shuffle(rows)
    schema = "conv_id bigint, turn bigint, role string, text string, kind int, chunk int"
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], schema)
    for window, context in ((32, 4), (3, 1), (5, 5)):
        formatted = format_conversations(df.repartition(7), window=window, context=context)
        assert got(read_back(formatted)) == expected(rows)
    assert all(len(r.turns) <= 5 and all(t.rewrites is None for t in r.turns) for r in formatted.collect())
    assert read_back(format_conversations(df.limit(0))).collect() == []


def test_any_template_is_located(spark):
    def template(turns):
        out = "<s>"
        for i, (role, text) in enumerate(turns):
            again = " again" if i and turns[i - 1][0] == role else ""
            out += f"[{role.upper()}{again}] {text.replace('[', '[[')} [/]"
        return out

    rows = [(1, t, "user" if t % 3 else "assistant", f"[text {t}]" * (t % 4)) for t in range(50)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    parts = sorted(format_conversations(df, template, window=8, context=2).collect(), key=lambda r: (r.chunk, r.part))
    assert "".join(p.head + "".join(t.piece for t in p.turns) for p in parts) == template([r[2:] for r in rows])
    turns = [t for p in parts for t in p.turns]
    assert [t.piece[t.text_start : t.text_end] for t in turns] == [r[3].replace("[", "[[") for r in rows]
    assert [t.loss for t in turns] == [r[2] == "assistant" for r in rows]
    assert [p.whole for p in parts] == [False] * 7


def test_templates_that_rewrite_history_are_detected(spark):
    def drops_earlier_thoughts(turns):
        kept = [(r, t if i == len(turns) - 1 else t.split("</think>")[-1]) for i, (r, t) in enumerate(turns)]
        return render(kept)

    def system_first(turns):
        return render(sorted(turns, key=lambda t: t[0] != "system"))

    turns = [("user", "q"), ("assistant", "hm</think>a"), ("user", "q2"), ("assistant", "a2")]
    assert [x[3] for x in locate(drops_earlier_thoughts, [], turns)] == [None, None, 1, None]
    late = [("user", "a"), ("assistant", "b"), ("system", "c")]
    assert [x[3] for x in locate(system_first, [], late)] == [None, None, 0]
    assert [x[3] for x in locate(render, [], turns)] == [None] * 4
    # a text that is not shown, and one that is shown twice
    hidden = list(locate(lambda ts: render([t for t in ts if t[0] != "tool"]), [], [("user", "a"), ("tool", "b")]))
    twice = list(locate(lambda ts: "".join(f"{t}:{t};" for _, t in ts), [], [("user", "a")]))
    assert hidden[1] == ("", -1, -1, None) and twice[0][1:3] == (-1, -1)
    rows = [(7, i, r, t) for i, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    found = format_conversations(df, drops_earlier_thoughts).collect()[0].turns
    assert [t.rewrites for t in found] == [None, None, 1, None]
