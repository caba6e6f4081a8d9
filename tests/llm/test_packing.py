import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from fleetlake.llm.bpe import Bpe
from fleetlake.llm.packing import pack
from fleetlake.llm.queries import op7_pack, tokenizer_path
from tests.conftest import SF_SMALL


def check_pieces(rows, texts, window=2048):
    """Every id of every document lies in one piece, and windows are gapless and not overfull."""
    t = Tokenizer.from_file(tokenizer_path())
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in texts.items()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by_doc) == set(want)
    for i, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            ids = np.array(want[i][r.start : r.start + r.length], "<u4")
            assert r.start == at and r.length == len(ids) > 0 and r.doc_tokens == len(want[i])
            assert zlib.crc32(ids.tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(want[i])
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    return sum(map(len, want.values())) / (len(by_sequence) * window)


def test_query_packs_every_id_once(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert check_pieces(op7_pack(spark, SF_SMALL).collect(), texts) > 0.97


def test_small_windows_many_tasks_and_merges(spark):
    rng = random.Random(3)
    texts = {i: " ".join(rng.choice(["ab", "token", "ñandú", "x1"]) for _ in range(rng.randint(0, 60))) for i in range(300)}
    texts[300], texts[301] = None, "long " * 5000
    docs = spark.createDataFrame(
        [(i, t, 1, 2) for i, t in texts.items()], "doc_id bigint, text string, start int, closed int"
    ).repartition(13)
    rows = pack(docs, tokenizer_path(), window=64, open_windows=3, min_cut=8, merge_groups=3).collect()
    assert check_pieces(rows, texts, 64) > 0.9


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert pack(docs, tokenizer_path()).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_ids_equal_the_library(seed):
    rng = random.Random(seed)
    letters = " \n\t'streveml2dA.,!ñß½\xa0\x85\x1c"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    texts += ["", "", "it's we're 'S ''s", "<|endoftext|>x", "日本 語 a", "x" * 5000, " " * 50, "\n\n a"]
    bpe = Bpe(tokenizer_path())
    want = [e.ids for e in bpe.whole.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in bpe.encode(texts)] == want
