"""Totals of class TF-IDF, which are worked out from the lengths of the texts, against counting the n-grams."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from consensa.operators import vectors


def _rows():
    rng = random.Random(8)
    rows = [(rng.choice(["a", "a", "b", None]), k, [rng.choice("stuvw") for _ in range(rng.choice([0, 1, 2, 3, 9]))]) for k in range(40)]
    return [*rows, ("a", 41, None), ("none", 42, []), ("none", 43, None), ("one", 44, ["s"])]


@pytest.mark.parametrize("n_min,n_max,span", [(1, 3, False), (2, 3, False), (1, 1, True), (1, 3, True), (2, 4, True)])
def test_scores_against_counting(spark, n_min, n_max, span):
    texts = {}
    for c, _, tok in _rows():
        texts.setdefault(c, []).append(tok or [])
    if span:
        texts = {c: [[t for tok in x for t in tok]] for c, x in texts.items()}
    counts = {c: Counter(" ".join(t[i:i + n]) for t in x for n in range(n_min, n_max + 1) for i in range(len(t) - n + 1)) for c, x in texts.items()}
    df = Counter(t for c in counts.values() for t in c)
    clusters = len(texts)
    want = {(c, t): n / sum(k.values()) * (math.log((clusters + 1) / (df[t] + 1)) + 1) for c, k in counts.items() if c is not None for t, n in k.items()}
    docs = spark.createDataFrame(_rows(), "cluster string, at int, tok array<string>").repartition(4)
    got = vectors.class_tfidf(docs, "cluster", "tok", n_min, n_max, span_messages=span, order_col="at")
    found = {(r["cluster"], r["term"]): r["score"] for r in got.collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - w) < 1e-12 for k, w in want.items())


def test_no_grams_are_made_for_the_totals(spark):
    docs = spark.createDataFrame(_rows(), "cluster string, at int, tok array<string>")
    plan = vectors.class_tfidf(docs, "cluster", "tok").select(F.sum("score"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1
