"""Terms counted in blocks of documents: against a plain count, and without rows of (document, term) in a shuffle."""
import math
import random
from collections import Counter, defaultdict

import pytest

from consensa.operators import vectors


def _rows():
    rng = random.Random(5)
    rows = [(i, [rng.choice("abcdefgh") * 2 for _ in range(rng.randrange(0, 30))]) for i in range(60)]
    rows += [(7, ["aa", "zz", "aa"]), (None, ["aa", "qq"]), (None, ["qq", "bb"]), (90, None), (91, []), (92, ["aa", None, "bb"]),
             (93, ["aa bb", "é€"]), (94, ["aa", "bb", "é€"]), (95, [None, None]), (96, ["", "aa"])]
    return rows


def _plain(rows, n_min, n_max, min_df, max_df):
    counts = defaultdict(Counter)
    for doc, tok in rows:
        for n in range(n_min, n_max + 1):
            for i in range(len(tok or []) - n + 1):
                gram = tok[i:i + n]
                if n > 1 or gram[0] is not None:  # a null token is no term; in longer ones it is left out
                    counts[doc][" ".join(t for t in gram if t is not None)] += 1
    df = Counter(t for c in counts.values() for t in c)
    hi = max_df * len(rows) if isinstance(max_df, float) else max_df
    return {(d, t): (n, df[t]) for d, c in counts.items() for t, n in c.items() if min_df <= df[t] <= hi}


@pytest.mark.parametrize("n_min,n_max,block", [(1, 1, 40), (1, 2, 100), (2, 3, 50), (1, 2, 10**6)])
def test_counts_and_weights_are_those_of_a_plain_count(spark, n_min, n_max, block):
    docs = spark.createDataFrame(_rows(), "id long, tok array<string>").repartition(5)
    want = _plain(_rows(), n_min, n_max, 2, 0.9)
    lists, n = vectors.term_lists(docs, "id", "tok", n_min, n_max, 2, 0.9, block)
    lists = lists.localCheckpoint()
    got = [(r["doc"], t["term"], t["n"], t["df"]) for r in lists.collect() for t in r["terms"]]
    assert n == len(_rows()) and len(got) == len(want) and {(d, t): (k, f) for d, t, k, f in got} == want
    raw = {k: c * (math.log((1 + n) / (1 + f)) + 1) for k, (c, f) in want.items()}
    norm = defaultdict(float)
    for (d, _), w in raw.items():
        norm[d] += w * w
    weights = {(r["doc"], r["term"]): r["w"] for r in vectors.tfidf(lists, n).collect()}
    assert weights.keys() == raw.keys() and all(abs(weights[k] - w / math.sqrt(norm[k[0]])) < 1e-12 for k, w in raw.items())


def test_empty_and_wordless_tables(spark):
    for rows in ([], [(1, []), (2, None)]):
        counts, vocab, n = vectors.term_counts(spark.createDataFrame(rows, "id long, tok array<string>"), "id", "tok")
        assert n == len(rows) and counts.count() == vocab.count() == 0


def test_no_shuffle_of_documents_terms(spark):
    docs = spark.createDataFrame(_rows(), "id long, tok array<string>")
    counts, vocab, _ = vectors.term_counts(docs, "id", "tok", 1, 2)
    assert {tuple(r) for r in vocab.collect()} == {tuple(r) for r in counts.select("term", "df").collect()}
    lists, n = vectors.term_lists(docs, "id", "tok", 1, 2)
    for df in (counts, vectors.tfidf(lists, n)):
        dealt = [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x]
        assert dealt and all("hashpartitioning(b" in x for x in dealt)  # by block or bucket alone
