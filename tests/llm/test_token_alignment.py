import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from consensa.llm import token_alignment as t
from consensa.llm.common import read

SF = "/root/testdata/sf0.001"
SOME = ["a", "Über", "naïve", "\U0001F600\U0001F468‍\U0001F469", "  ", " ", "\n", "\t", "x" * 70, "don't", "<|endoftext|>", "<s>", "</s>", "<unk>", "1234567",
        "的是", "­", "\x00", "\x1c", " ", "é", "ﬁ", "...", "<0x41>", "\x85", "_", "$%", "hello world", "\r\n", "　"]


@pytest.fixture(scope="module")
def both():
    return t.tokenizers()()


def whole(both, text):
    """Ids by encoding space + text at once, or None."""
    if not text:
        return None
    a, b = both.of_a.encode(" " + text, add_special_tokens=False).ids, both.of_b.encode(text)
    same = all(b"".join(of[i] for i in ids) == (" " + text).encode() for of, ids in ((both.a_bytes, a), (both.b_bytes, b)))
    return (a, b) if same else None


def brute(both, rows):
    """(documents, pairs) by walking both sides token by token."""
    links, docs = {}, []
    for key, text in rows:
        ids = whole(both, text)
        groups, own, a, b = [], [], [], []
        if ids:
            i = j = at_a = at_b = 0
            while i < len(ids[0]):
                end_a, end_b = at_a + len(both.a_bytes[ids[0][i]]), at_b + len(both.b_bytes[ids[1][j]])
                own.append((ids[0][i], ids[1][j]))
                if end_a <= end_b:
                    a.append(ids[0][i])
                if end_b <= end_a:
                    b.append(ids[1][j])
                i, at_a, j, at_b = i + (end_a <= end_b), end_a if end_a <= end_b else at_a, j + (end_b <= end_a), end_b if end_b <= end_a else at_b
                if end_a == end_b:
                    groups.append(",".join(map(str, a)) + "|" + ",".join(map(str, b)))
                    a, b = [], []
        for x in own:
            links[x] = links.get(x, 0) + 1
        docs.append((key, len(ids[0]) if ids else 0, len(ids[1]) if ids else 0, groups, own))
    most = {}
    for (_, b), n in links.items():
        most[b] = max(most.get(b, 0), n)
    return sorted(((k, na, nb, len(g), len(own), sum(links[x] == most[x[1]] for x in own), sum(links[x] for x in own), ";".join(g))
                   for k, na, nb, g, own in docs), key=str), sorted((a, b, n, n == most[b]) for (a, b), n in links.items())


def got(spark, df, work=t.WORK, key="doc_id"):
    docs, pairs = t.aligned(df, work=work, key=key)
    return (sorted((tuple(r) for r in docs.select(key, *t.COUNTS, "groups").collect()), key=str),
            sorted(tuple(r) for r in pairs.select("a", "b", "count", "best").collect()))


def texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(SOME) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_parts_give_the_ids_of_whole_texts(both):
    assert both.by_parts
    every = [*texts(1, 3000), None, "", "long " * 300_000, *(r.text for r in _docs())]
    for text, ids in zip(every, both(every), strict=True):
        assert (ids and tuple(x.tolist() for x in ids)) == whole(both, text), text


def _docs():
    from types import SimpleNamespace

    import pyarrow.parquet as pq
    return [SimpleNamespace(text=x) for x in pq.read_table(f"{SF}/documents.parquet").column("text").to_pylist()]


def test_merge_path_cuts_anywhere():
    rng = np.random.default_rng(5)
    for _ in range(200):
        top = rng.integers(1, 60)
        a, b = (np.unique(np.append(rng.integers(1, top + 1, rng.integers(0, 40)), top)) for _ in range(2))
        d = np.arange(0, len(a) + len(b) + 1)
        i, j = t.merge_path(a, b, d)
        for x, y, k in zip(i, j, d, strict=True):
            assert x + y in (k, k + 1)
            assert not x or y == len(b) or a[x - 1] < b[y]
            assert not y or x == len(a) or b[y - 1] < a[x]


@pytest.mark.parametrize("work", [1, 7, 40, t.WORK])
def test_against_brute_force(spark, both, work):
    rows = [(i, x) for i, x in enumerate(texts(2, 60))] + [
        (100, None), (101, ""), (102, " "), (103, "a▁b"), (104, "▁"), (None, "no key"), (None, None), (7, "twice the same"), (7, "twice the same"),
        (105, "x" * 500), (106, "é" * 300)]
    df = spark.createDataFrame([(k, x, 1, "g") for k, x in rows], "doc_id long, text string, n_a int, groups string").repartition(3)
    docs, pairs = brute(both, rows)
    assert got(spark, df, work) == (docs, pairs)


def test_query_against_brute_force(spark, both):
    import hashlib
    rows = [(r.doc_id, r.text) for r in read(spark, SF, "documents").collect()]
    docs, _ = brute(both, rows)
    out = sorted((tuple(r) for r in t.QUERIES["op13_token_alignment"](spark, SF).collect()), key=str)
    assert out == sorted(((*d[:-1], hashlib.sha256(d[-1].encode()).hexdigest() if d[1] else "") for d in docs), key=str)


def test_a_text_of_many_pieces(spark, both):
    rng = random.Random(9)
    rows = [(1, " ".join(rng.choice(SOME) for _ in range(20_000))), (2, "y" * 30_000), (3, "short")]
    assert got(spark, spark.createDataFrame(rows, "doc_id long, text string"), 1000) == brute(both, rows)


def test_no_rows_and_other_keys(spark, both):
    df = spark.createDataFrame([("k", "some text")], "groups string, text string")
    docs, pairs = t.aligned(df, key="groups")
    assert docs.columns == ["key", *t.COUNTS, "groups"] and docs.first().key == "k"
    docs, pairs = t.aligned(df.limit(0), key="groups")
    assert docs.collect() == [] and pairs.collect() == []


def test_the_sides_of_a_hot_pair(spark, both):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("the same").alias("text"))
    docs, pairs = t.aligned(df, work=500)
    assert {r["count"] for r in pairs.collect()} == {3000} and docs.select(F.sum("n_best")).first()[0] == docs.select(F.sum("n_links")).first()[0]


def test_a_worker_loads_the_tokenizers_once():
    make, other = t.tokenizers(), t.tokenizers()
    assert make() is make()
    assert make() is other()
