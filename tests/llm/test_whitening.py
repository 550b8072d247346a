import math
import random

import numpy as np
import pytest

from consensa.llm import whitening as w
from consensa.llm.common import read

SF = "/root/testdata/sf0.001"


def brute(rows, dims, most=8):
    """key -> (deviation, whitened without signs), and the eigenvalues' shares, by numpy's eigensolver."""
    good = [(k, v) for k, v in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in good]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    y = np.array([[a - b / n for a, b in zip(row, s, strict=True)] for row in x])
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    dev = [sum((n * a - b) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    return n, [(k, d, np.abs(p)) for (k, _), d, p in zip(good, dev, y @ u / np.sqrt(e), strict=True)], e / (y ** 2).sum() * n


def check(out, rows, dims, most=8):
    n, want, share = brute(rows, dims, most)
    got = {}
    for r in out:
        got.setdefault(r.vec_id, {})[r.component] = r
        assert r.n == n and r.identity_error < 1e-9 and abs(r.explained / share[r.component - 1] - 1) < 1e-9
    assert len(out) == sum(len(p) for _, _, p in want)
    for k, d, p in want:
        assert all(int(got[k][i + 1].deviation) == d for i in range(len(p)))
        assert np.allclose([abs(got[k][i + 1].whitened) for i in range(len(p))], p, rtol=1e-8, atol=1e-8)


def test_query_against_numpy(spark):
    rows = [(r.vec_id, r.embedding) for r in read(spark, SF, "embeddings").collect()]
    check(w.QUERIES["op11_whitening"](spark, SF).collect(), rows, 64)


def test_rows_left_out_and_clashing_columns(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 3 - j / 2) for j in range(5)]) for i in range(300)]
    odd = [(900, None), (901, []), (902, [1.0, None, 0.0, 0.0, 0.0]), (903, [1.0, float("nan"), 0.0, 0.0, 0.0]), (904, [1.0, 2.0]),
           (905, [1.0, float("inf"), 0.0, 0.0, 0.0]), (906, [1e300, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(k, v, 1.5, "x") for k, v in rows + odd], "vec_id long, embedding array<double>, whitened double, n string")
    out = w.whiten(df.repartition(7)).collect()
    check(out, rows, 5)
    assert {type(r.deviation).__name__ for r in out} == {"Decimal"}


def test_repeated_rows_and_null_keys_count(spark):
    rng = random.Random(4)
    rows = [(None, [rng.random(), rng.random(), rng.random()]) for _ in range(50)]
    out = w.whiten(spark.createDataFrame(rows + rows[:5] * 40, "vec_id long, embedding array<float>"), most=2).collect()
    assert len(out) == 2 * 250 and out[0].n == 250 and out[0].identity_error < 1e-9 and all(r.vec_id is None for r in out)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_no_variance_no_components(spark, rows):
    assert w.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect() == []


def test_directions_without_variance_have_no_component(spark):
    rows = [(i, [float(i), float(-i), 5.0, float(i * i)]) for i in range(40)]
    out = w.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in out} == {1, 2} and out[0].identity_error < 1e-9
    assert abs(sum({r.component: r.explained for r in out}.values()) - 1) < 1e-12


def test_large_entries_stay_exact(spark):
    rows = [(i, [1e9 + i, -1e9 - i * i]) for i in range(30)]
    check(w.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), rows, 2)


def test_factor_and_rotation():
    rng = np.random.default_rng(1)
    for rank, dims in ((1, 1), (3, 7), (12, 12), (5, 9)):
        b = rng.normal(size=(dims, rank)) * np.logspace(0, 2, rank)
        a = b @ b.T
        factor = w.pivoted_cholesky(a)
        assert factor.shape == (dims, rank) and np.allclose(factor @ factor.T, a, rtol=1e-10, atol=1e-10 * np.abs(a).max())
        u = w.one_sided_jacobi(factor)
        norms = np.sqrt((u ** 2).sum(0))
        assert np.abs((u / norms).T @ (u / norms) - np.eye(rank)).max() < 1e-12
        assert np.allclose(norms, np.linalg.svd(factor, compute_uv=False), rtol=1e-12)
        assert np.allclose(norms ** 2, np.linalg.eigvalsh(a)[::-1][:rank], rtol=1e-8)
    assert w.one_sided_jacobi(w.pivoted_cholesky(np.zeros((3, 3)))).shape == (3, 0)
