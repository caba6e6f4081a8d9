import math
import random
import re
import zlib

from pyspark.sql import functions as F

from fleetlake.llm.common import labelled_sample
from fleetlake.llm.queries import op2_toxicity
from fleetlake.llm.toxicity import ALPHA, BETA, EPOCHS, L1, L2, POSITIVE, fit, held_out, score
from tests.conftest import SF_MID


def texts(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(3))
    out = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 60))]
        if i % 4 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(["Vile!", "nasty"]))
        out.append((i, " ".join(words), int(i % 4 == 0)))
    return out


def test_held_out_accuracy_on_planted_words(spark):
    train = spark.createDataFrame(texts(1, 600), "doc_id bigint, text string, label int")
    weights = fit(train.drop("label"), train.select("doc_id", "label"))
    assert len(weights) < 2000  # L1 leaves few of 2**20
    rows = score(spark.createDataFrame(texts(2, 300), "doc_id bigint, text string, score int"), weights).collect()
    toxic = {r.doc_id: r.score for r in rows if r.doc_id % 4 == 0}
    clean = {r.doc_id: r.score for r in rows if r.doc_id % 4}
    assert sum(s >= 0.7 for s in toxic.values()) > 0.95 * len(toxic)
    assert sum(s >= 0.7 for s in clean.values()) == 0


def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
    pairs = list(zip(words, words[1:])) + list(zip(words, ["*"] * len(words), words[2:]))
    return {("bias",), *((w,) for w in words), *pairs}


def plain_ftrl(rows):
    """Weights by the published update rule, one feature at a time, with features as they are written."""
    z, n = {}, {}

    def weight(f):
        if abs(z.get(f, 0.0)) <= L1:
            return 0.0
        return -(z[f] - math.copysign(L1, z[f])) / ((BETA + math.sqrt(n[f])) / ALPHA + L2)

    for _ in range(EPOCHS):
        for text, label in rows:
            w = {f: weight(f) for f in plain_features(text)}
            g = (1 / (1 + math.exp(-sum(w.values()))) - label) * (POSITIVE if label else 1.0)
            for f in w:
                rate = (math.sqrt(n.get(f, 0.0) + g * g) - math.sqrt(n.get(f, 0.0))) / ALPHA
                z[f] = z.get(f, 0.0) + g - rate * w[f]
                n[f] = n.get(f, 0.0) + g * g
    return {f: weight(f) for f in z if weight(f)}


def test_fit_and_score_equal_a_plain_loop(spark, monkeypatch):
    import fleetlake.llm.toxicity as toxicity

    monkeypatch.setattr(toxicity, "PIECE", 8)  # most texts are cut
    rng = random.Random(5)
    docs = []
    for i in range(500):
        words = [rng.choice(["Ant", "bee,", "cow", "dog", "elk", "fox"]) for _ in range(rng.randint(0, 25))]
        words += ["vile", "rat"] * (i % 5 == 0)
        docs.append((i, " ".join(words), int(i % 5 == 0)))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, label int").repartition(7)
    labels = frame.select("doc_id", "label")
    weights = fit(frame.drop("label"), labels)
    want = plain_ftrl([(r.text, r.label) for r in labelled_sample(frame.drop("label"), labels, 20_000).orderBy("order").collect()])
    assert len(want) >= 10 and len(weights) == len(want)
    assert sorted(round(w, 6) for w in weights.values()) == sorted(round(w, 6) for w in want.values())
    text = {i: t for i, t, _ in docs}
    for r in score(frame, weights).collect():
        total = sum(want.get(f, 0.0) for f in plain_features(text[r.doc_id]))
        assert abs(r.score - 1 / (1 + math.exp(-total))) < 1e-5


def test_pieces_of_tied_rows_stay_together(spark):
    """Rows of one id, equal or not, and a text of many pieces: the same weights however they are partitioned."""
    long = " ".join(f"w{i}" for i in range(6000))
    docs = [(1, long), (1, long), (1, "vile rat " * 3), (2, None)] + [(i, f"vile rat {i}") for i in range(3, 60)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i != 1)) for i in range(1, 60)], "doc_id bigint, label int")
    one = fit(frame.coalesce(1), labels)
    assert one and one == fit(frame.repartition(9), labels)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "nasty " * 50000), (None, "x"), (4, "a"), (4, "a")]
    df = spark.createDataFrame([(*d, "z") for d in docs], "doc_id bigint, text string, order string")
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, 0), (None, 1), (1, None), (99, 1)], "doc_id bigint, label int")
    rows = score(df, fit(df, labels)).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert fit(df, labels.limit(0)) == {}
    assert {r.score for r in score(df, {}).collect()} == {0.5}
    assert score(df.limit(0), {}).collect() == []


def test_query(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    rows = op2_toxicity(spark, SF_MID).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF_MID}/labels.parquet").collect()}
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    pairs = [(a, b) for a, x in held for b, y in held if x == 1 and y == 0]
    assert sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs) > 0.85
    assert docs.filter(held_out()).count() == sum(r.held_out for r in rows)
    assert docs.select(F.max("doc_id")).first()[0] == max(r.doc_id for r in rows)
