import random
import zlib
from array import array

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from consensa.llm import packing as p


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_encoder_gives_the_tokenizers_ids(reference):
    encode, rng = p.byte_bpe()(), random.Random(3)
    alphabet = " \n\t  ab'séñ1.!$ 　|<́語\U0001F600\r\x1c\x85"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    texts += ["", " ", "a <|endoftext|> b", "<|endoftext|>", "a<|endoftext|>b c", "it's  we'll\n\n x "]
    for t in texts:
        assert encode(t) == array("H", reference.encode(t, add_special_tokens=False).ids).tobytes(), repr(t)


def test_forgetting_words_changes_nothing(monkeypatch):
    words = [f"w{i % 37}x" for i in range(500)]
    whole = p.byte_bpe()()(" ".join(words))
    monkeypatch.setattr(p, "CACHED_WORDS", 5)
    assert p.byte_bpe()()(" ".join(words)) == whole


TEXTS = [None, "", "one", "word " * 3000, "one", "x  y\n\n z", "word " * 2047]


def test_pieces_cover_every_id_once(spark, reference):
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(TEXTS)], "doc_id long, text string, start int").repartition(3)
    rows = sorted(p.pack(df).collect(), key=lambda r: (r.sequence_id, r.offset))
    at = 0
    for r in rows:  # gapless, and all sequences but the last are full
        assert r.sequence_id * p.SEQUENCE + r.offset == at
        at += r.length
        assert r.offset + r.length <= p.SEQUENCE
    for i, t in enumerate(TEXTS):
        ids = [*reference.encode(t or "", add_special_tokens=False).ids, p.END_ID]
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in own) == array("I", ids).tobytes()
        assert all(r.doc_tokens == len(ids) for r in own)


def test_query_digest(spark, reference):
    rows = p.q_packing(spark, "/root/testdata/sf0.001").collect()
    text = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(text)
    for r in rows[:60]:
        ids = [*reference.encode(text[r.doc_id] or "", add_special_tokens=False).ids, 1]
        assert r.ids_crc32 == zlib.crc32(array("I", ids[r.start:r.start + r.length]).tobytes())


def test_empty_table(spark):
    assert p.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
