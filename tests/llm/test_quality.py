import random

from fleetlake.llm.quality import resample, select_documents
from fleetlake.llm.queries import op6_quality
from tests.conftest import SF_MID


def test_query_keeps_good_and_rejects_bad(spark):
    rows = {r.doc_id: r for r in op6_quality(spark, SF_MID).collect()}
    labels = spark.read.parquet(f"{SF_MID}/labels.parquet").collect()
    assert len(rows) == spark.read.parquet(f"{SF_MID}/documents.parquet").count()
    good = [rows[r.doc_id].selected for r in labels if r.quality == 1]
    bad = [rows[r.doc_id].selected for r in labels if r.quality == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.05 * len(bad)


def _docs(spark):
    rng = random.Random(1)
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(n))
    docs = [(i, words(30).capitalize() + ".") for i in range(60)] + [(60 + i, words(30).upper() + "!!") for i in range(20)]
    docs += [(80, None), (81, ""), (82, "X!! " * 20000), (0, docs[0][1]), (None, words(30).capitalize() + ".")]
    return spark.createDataFrame([(*d, 1.5, "q") for d in docs], "doc_id bigint, text string, log_weight double, noise string")


def test_sample_sizes_and_columns(spark):
    docs = _docs(spark)
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(0, 80, 2)], "doc_id bigint, label int")
    rows = resample(docs, labels).collect()
    assert len(rows) == docs.count()
    taken = {r.doc_id for r in rows if r.selected}
    assert set(range(60)) | {None} == taken
    ten = [r for r in resample(docs, labels, take=10).collect() if r.selected]
    assert len(ten) in (10, 11)  # equal rows enter together
    assert min(r.sample_key for r in ten) > max(
        [r.sample_key for r in resample(docs, labels, take=10).collect() if not r.selected]
    )
    kept = select_documents(docs, labels)
    assert kept.dtypes == docs.dtypes and {r.doc_id for r in kept.collect()} == taken


def test_weights_match_brute_force_models(spark):
    """Each text's weight is the sum over its n-grams of the log ratio of the two models."""
    import numpy as np

    from fleetlake.llm.quality import FORM_BITS, FORM_PRIOR, SLOTS, WORD_PRIOR, all_slots, log_ratios

    docs = _docs(spark)
    labels = spark.createDataFrame([(i, 1) for i in range(0, 30)], "doc_id bigint, label int")
    texts = [((r.text or "").encode(), r.doc_id) for r in docs.collect()]
    count = lambda ts: np.bincount(all_slots(ts)[1], minlength=SLOTS)
    target, raw = count([t for t, i in texts if i is not None and i < 30]), count([t for t, _ in texts])
    (tf, tw), (rf, rw) = np.split(target, [1 << FORM_BITS]), np.split(raw, [1 << FORM_BITS])
    want = np.concatenate([
        np.log((tf + FORM_PRIOR) / (rf * tf.sum() / rf.sum() + FORM_PRIOR)),
        np.log((tw + WORD_PRIOR) / (rw * tw.sum() / rw.sum() + WORD_PRIOR)),
    ])
    assert np.allclose(log_ratios(docs, labels), want)
    rows = sorted((str(r.doc_id), r.log_weight) for r in resample(docs, labels).collect())
    brute = sorted((str(i), float(want[all_slots([t])[1]].sum())) for t, i in texts)
    assert [i for i, _ in rows] == [i for i, _ in brute]
    assert np.allclose([x for _, x in rows], [x for _, x in brute])


def test_word_slots_match_a_plain_count():
    """Each word and each pair of words of one text falls in one slot, and equal ones in the same slot."""
    import re
    from collections import Counter

    from fleetlake.llm.quality import word_slots

    texts = ["A b a-b. c", "", "...", "b A", "\u00e9t\u00e9 B a"]
    plain = []
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
        plain += [(i, (w,)) for w in words] + [(i, p) for p in zip(words, words[1:])]
    doc, slot = word_slots([t.encode() for t in texts])
    assert Counter(doc.tolist()) == Counter(i for i, _ in plain)
    assert sorted(Counter(slot.tolist()).values()) == sorted(Counter(g for _, g in plain).values())


def test_words_decide_where_forms_are_equal(spark):
    """Texts of the same case, marks and length: those of the target's words are taken, the others not."""
    rng = random.Random(3)
    text = lambda words: " ".join(rng.choice(words) for _ in range(40)).capitalize() + "."
    good, spam = ["river", "stone", "cloud", "field"], ["prize", "bonus", "click", "offer"]
    docs = [(i, text(good)) for i in range(300)] + [(300 + i, text(spam)) for i in range(60)]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(150)], "doc_id bigint, label int")
    assert {r.doc_id for r in resample(docs, labels).collect() if r.selected} == set(range(300))


def test_held_out_labels(spark):
    """Fitted on two thirds of the labels, the models tell the other third apart."""
    import zlib

    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    labels = spark.read.parquet(f"{SF_MID}/labels.parquet").selectExpr("doc_id", "quality AS label")
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    rows = resample(docs, labels.filter("crc32(cast(doc_id AS string)) % 3 <> 1")).collect()
    taken = {r.doc_id: r.selected for r in rows}
    good = [taken[r.doc_id] for r in labels.collect() if r.label == 1 and held(r.doc_id)]
    bad = [taken[r.doc_id] for r in labels.collect() if r.label == 0 and held(r.doc_id)]
    assert good and bad and sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_no_target_and_empty_table(spark):
    docs = _docs(spark)
    none = spark.createDataFrame([], "doc_id bigint, label int")
    assert all(r.selected for r in resample(docs, none).collect())
    assert resample(docs.limit(0), none).collect() == []
    assert select_documents(docs.limit(0), none).collect() == []
