import hashlib
import random
import re

from pyspark.sql import functions as F

from fleetlake.llm.personal_data import find_matches, personal_data, redact
from fleetlake.llm.queries import op3_personal_data
from tests.conftest import SF_SMALL


def digits(s):
    return re.sub("[^0-9]", "", s)


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(digits(s))):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(s)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
}


def base_spans(text):
    return [
        (kind, m.start(), m.end())
        for kind, (pattern, holds) in BASE.items()
        for m in re.finditer(pattern, text or "")
        if holds(m[0])
    ]


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_query_base_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    rows = op3_personal_data(spark, SF_SMALL).collect()
    assert len(rows) == len(texts) and sum(r.n_email + r.n_card for r in rows) > 0
    for r in rows:
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == digest(want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in want) for x in BASE)
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r.spans.split(",")) | {""}


def test_random_and_odd_texts_match_brute_force(spark):
    rng = random.Random(4)
    bits = ["a.b", "@", "x-y.org", "%", "+1", " ", "-", "(555)", "4111111111111111", "4111 1111 1111 1111", "12", ".",
            "255", "256", "1.2.3.4", "é😀", "\n", "0", "  ", "me@x.io", "+49 30 1234567"]
    docs = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))) for i in range(500)]
    docs += [(500, None), (501, ""), (502, "1 " * 20000), (503, "a" * 200000), (504, "9" * 50000), (505, "a@b.c%d@e.f.")]
    docs += [(None, "x me@x.io"), (None, "x me@x.io")]
    df = spark.createDataFrame([(*d, 1, "c") for d in docs], "doc_id bigint, text string, start int, context string")
    rows = personal_data(df).collect()
    assert len(rows) == len(docs)
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.base] for r in rows}
    assert got == {i: base_spans(t) for i, t in docs}
    assert personal_data(df.limit(0)).collect() == []


def test_patterns_of_seeds_find_unseen_identifiers(spark):
    rng = random.Random(2)
    docs = [(i, f"please write to contact {'me%d@mail.org' % i} soon") for i in range(8)]
    docs += [(20 + i, f"please write to contact user{1000 + i} soon") for i in range(2)]
    docs += [(40 + i, f"the order number {rng.randint(10000, 99999)} was sent") for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    found = {r.doc_id: [s for s in r.spans if s.kind == "found"] for r in personal_data(df).collect()}
    assert [(s.start, s.end) for s in found[20]] == [(24, 32)]
    assert all(not found[40 + i] for i in range(20))


def test_redact_keeps_columns_and_the_rest_of_the_text(spark):
    docs = [(1, "mail a.b@c.org now", "en", 18), (2, "nothing", "en", 7), (3, None, None, None), (4, "1.2.3.4", "de", 7)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, n_chars bigint")
    out = redact(df)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    assert {(r.doc_id, r.text, r.n_chars) for r in out.collect()} == {
        (1, "mail [EMAIL] now", 16), (2, "nothing", 7), (3, None, None), (4, "[IP]", 4),
    }
    plans = personal_data(df).select(F.col("spans"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plans and "Arrow" not in plans


def test_a_pattern_does_not_raise_its_own_confidence(spark):
    for seeds, other in ((5, 7), (50, 50), (500, 300)):
        docs = [(i, f"please send to {'me%d@mail.org' % i} soon") for i in range(seeds)]
        docs += [(1000 + i, f"please send to {70000 + 7 * i} soon") for i in range(other)]
        df = spark.createDataFrame(docs, "doc_id bigint, text string")
        assert not [r for r in personal_data(df, rounds=6).collect() if any(s.kind == "found" for s in r.spans)]


def test_found_values_become_seeds_and_are_reported_everywhere(spark):
    docs = [(i, f"please write to contact {'me%d@mail.org' % i} soon") for i in range(40)]
    docs += [(100 + i, f"please write to contact staff{1000 + i} soon") for i in range(9)]
    docs += [(200 + i, f"his badge number staff{1000 + i} is new") for i in range(9)]
    docs += [(300, "his badge number staff7777 is new"), (301, "room of staff7777 and staff1003"), (302, "room of staff5555")]
    docs += [(400 + i, f"one order number {20000 + i} was sent") for i in range(20)] + [(500, "one order number staff1000 was sent")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    text = dict(docs)
    found = {r.doc_id: {text[r.doc_id][s.start : s.end] for s in r.spans if s.kind == "found"} for r in personal_data(df).collect()}
    assert all(found[200 + i] == {f"staff{1000 + i}"} for i in range(9))
    assert found[300] == {"staff7777"} and found[301] == {"staff7777", "staff1003"} and found[302] == set()
    assert not any(found[400 + i] for i in range(20)) and found[500] == {"staff1000"}


def test_lists_and_long_tokens_keep_their_context(spark):
    long = "k1" * 300
    texts = ["ids: 12345 67890 24680", "ids: " + " ".join(str(10000 + i) for i in range(60)), "row,12345,67890, 24680",
             f"session key {long} ends", "see 12345 to 67890", "see me@x.org to 67890", "mail a@b.org, c@d.org e@f.org", "abcde,123"]
    rows = find_matches(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    got = {r.doc_id: [(s.value, s.context) for s in r.tokens] for r in rows}
    m = "\ufffc"
    assert got[0] == [("12345", "ids:"), ("67890", f"ids: {m}"), ("24680", f"ids: {m}")]
    assert [c for _, c in got[1]] == ["ids:"] + [f"ids: {m}"] * 59
    assert [v for v, _ in got[2]] == ["12345", "67890", "24680"] and all(c for _, c in got[2])
    assert got[3] == [(long, "session key")] and got[7] == []
    assert got[4][1] == got[5][0] == ("67890", f"{m} to")
    mails = {r.doc_id: [s.context for s in r.email] for r in rows}[6]
    assert mails == ["mail", f"mail {m},", f"mail {m}"]
