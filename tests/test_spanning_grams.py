"""N-grams over joined messages against joining them in Python."""

import random
from collections import Counter

import pytest

from consensa.operators import vectors


def brute(rows, n_min, n_max):
    texts = {}
    for c, _, tok in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        texts.setdefault(c, []).extend(tok)
    return Counter((c, " ".join(t[i:i + n])) for c, t in texts.items() for n in range(n_min, n_max + 1) for i in range(len(t) - n + 1))


@pytest.mark.parametrize("n_min,n_max", [(1, 1), (1, 3), (2, 5)])
def test_spans_the_borders_of_messages_and_tasks(spark, n_min, n_max):
    rng = random.Random(n_max)
    # a cluster with most rows, small ones, a null one, empty and one-token messages (tails shorter than a gram), ties
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.randrange(120), rng.choices("uvwxyz", k=rng.choice([0, 1, 1, 1, 2, 4])))
            for _ in range(200)]
    rows += [("one", 1, ["u"]), ("none", 1, [])]
    df = spark.createDataFrame(rows, "cluster string, at int, tok array<string>")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = Counter((r["cluster"], r["term"]) for r in vectors.spanning_grams(df, "cluster", "at", "tok", n_min, n_max).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[0])
        spark.conf.set("spark.sql.shuffle.partitions", old[1])
    assert got == brute(rows, n_min, n_max)


def test_empty_table_and_missing_order(spark):
    df = spark.createDataFrame([], "cluster string, at int, tok array<string>")
    assert vectors.spanning_grams(df, "cluster", "at", "tok").collect() == []
    with pytest.raises(ValueError):
        vectors.class_tfidf(df, "cluster", "tok", span_messages=True)
