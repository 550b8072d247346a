import numpy as np
import pytest

from consensa.operators import svd
from consensa.plans import cluster_queries

SF = "/root/testdata/sf0.001"


def dense(rows):
    docs, terms = (sorted({r[i] for r in rows}) for i in (0, 1))
    a = np.zeros((len(docs), len(terms)))
    for d, t, w in rows:
        a[docs.index(d), terms.index(t)] = w
    return a, docs, terms


def compare(spark, rows, k, **how):
    a, docs, terms = dense(rows)
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    out = svd.term_svd(spark.createDataFrame(rows, "doc long, term string, w double").repartition(3), k, **how)
    n = len(out.values)
    assert np.allclose(out.values, s[:n], rtol=1e-6)
    v = {r.term: r.v for r in out.components.collect()}
    p = {r.doc: r.p for r in out.projections.collect()}
    sign = [1 if vt[j][np.argmax(np.round(np.abs(vt[j]), 9))] > 0 else -1 for j in range(n)]
    assert np.abs(np.array([v[t] for t in terms]) - (vt[:n].T * sign)).max() < 1e-6
    assert np.abs(np.array([p[d] for d in docs]) - (a @ vt[:n].T) * sign).max() < 1e-6
    return n


def test_documents_against_numpy(spark):
    w, _ = cluster_queries.doc_vectors(spark, SF)
    rows = [(r.doc, r.term, r.w) for r in w.collect()]
    assert compare(spark, rows, 6, oversample=40) == 6


@pytest.mark.parametrize("k", [1, 3, 50])
def test_small_and_singular(spark, k):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(12, 4)) @ rng.normal(size=(4, 9))  # of rank 4
    rows = [(i, f"t{j}", float(a[i, j])) for i in range(12) for j in range(9)]
    assert compare(spark, rows, k) == min(k, 4)


def test_empty_and_single(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "doc long, term string, w double")
    assert [(r.doc, r.reduced) for r in svd.reduce_term_dims(df, 5).collect()] == [(1, [1.0])]
    out = svd.term_svd(df.limit(0), 5)
    assert out.values == [] and out.components.collect() == [] and out.projections.collect() == []
