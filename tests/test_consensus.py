"""Consensus operators against a brute-force per-item implementation of the EM equations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from consensa.operators import consensus as ds

CLASSES = ["a", "b", "c"]
VOTES = [
    (1, "x", "a"), (1, "y", "a"), (1, "z", "b"),
    (2, "x", "b"), (2, "y", "b"),
    (3, "x", "c"), (3, "y", "a"), (3, "z", "c"), (3, "z", "c"),   # repeated vote
    (4, "x", "a"), (4, "y", "a"), (4, "z", "a"),
    (5, "x", "b"), (5, "y", "c"), (5, "z", "q"),                  # q is not a class
    (6, "z", "q"),                                                # only out-of-class votes
    (7, "x", "a"), (7, "y", "a"), (7, "z", "b"),                  # same pattern as item 1
]
ANN = ["x", "y", "z"]


def votes_df(spark, rows=VOTES):
    return spark.createDataFrame(rows, "item_id long, annotator string, label string")


def brute_em(votes, classes, annotators, iters, laplace=0.01, diag=0.6, gold=None, tol=0.0):
    """Plain per-item EM written from the update equations (test oracle)."""
    K = len(classes)
    ci = {c: i for i, c in enumerate(classes)}
    items = sorted({v[0] for v in votes})
    obs = {i: [(a, l) for (j, a, l) in votes if j == i and l in ci] for i in items}
    if gold is None:
        cnt = np.zeros(K)
        for i in items:
            for _, l in obs[i]:
                cnt[ci[l]] += 1
        pri = (cnt + 1) / (cnt.sum() + K) if cnt.sum() > 0 else np.full(K, 1 / K)
        conf = {a: np.full((K, K), (1 - diag) / max(K - 1, 1)) for a in annotators}
        for a in annotators:
            np.fill_diagonal(conf[a], diag)
    else:
        gc = np.zeros(K)
        for g in gold.values():
            if g in ci:
                gc[ci[g]] += 1
        pri = (gc + 1) / (len(gold) + K)
        post0 = {}
        for i in items:
            if i in gold:
                post0[i] = np.array([1.0 if c == gold[i] else 0.0 for c in classes])
            elif obs[i]:
                n = np.zeros(K)
                for _, l in obs[i]:
                    n[ci[l]] += 1
                s = (n / n.sum()) * np.maximum(pri, 1e-12)
                post0[i] = s / (s.sum() or 1.0)
            else:
                post0[i] = pri.copy()
        conf = {a: np.full((K, K), laplace) for a in annotators}
        for i in items:
            for a, l in obs[i]:
                conf[a][:, ci[l]] += post0[i]
        for a in annotators:
            conf[a] /= np.maximum(conf[a].sum(axis=1, keepdims=True), 1e-12)

    def scores(p, cf, i):
        s = np.log(np.maximum(p, 1e-12)).copy()
        for a, l in obs[i]:
            s += np.log(np.maximum(cf[a][:, ci[l]], 1e-12))
        return s

    def estep(p, cf):
        out = {}
        for i in items:
            if gold is not None and i in gold:
                out[i] = np.array([1.0 if c == gold[i] else 0.0 for c in classes])
            elif not obs[i]:
                out[i] = p.copy()
            else:
                s = scores(p, cf, i)
                e = np.exp(s - s.max())
                out[i] = e / e.sum()
        return out

    def ll(p, cf):
        t = 0.0
        for i in items:
            if not obs[i]:
                t += math.log(p.sum())
            else:
                s = scores(p, cf, i)
                t += s.max() + math.log(np.exp(s - s.max()).sum())
        return t

    hist = [ll(pri, conf)]
    post = None
    for _ in range(iters):
        post = estep(pri, conf)
        tot = sum(post.values())
        pri = tot / tot.sum()
        new = {a: np.full((K, K), laplace) for a in annotators}
        for i in items:
            for a, l in obs[i]:
                new[a][:, ci[l]] += post[i]
        conf = {a: new[a] / np.maximum(new[a].sum(axis=1, keepdims=True), 1e-12) for a in annotators}
        hist.append(ll(pri, conf))
        if abs(hist[-1] - hist[-2]) < tol:
            break
    return post, pri, conf, hist


def _post_map(df):
    return {r["item_id"]: np.array(r["post"]) for r in df.collect()}


@pytest.mark.parametrize("iters", [1, 3, 8])
def test_unsupervised_matches_brute_force(spark, iters):
    res = ds.ds_unsupervised(votes_df(spark), CLASSES, ANN, max_iters=iters, tol=0.0)
    post, pri, conf, hist = brute_em(VOTES, CLASSES, ANN, iters)
    got = _post_map(res.posterior)
    assert set(got) == set(post)
    for i in post:
        np.testing.assert_allclose(got[i], post[i], atol=1e-12)
    np.testing.assert_allclose(res.model.priors, pri, atol=1e-12)
    np.testing.assert_allclose(res.ll_history, hist, rtol=1e-12)


def test_semisupervised_matches_brute_force(spark):
    gold = {1: "a", 3: "c", 99: "b", 5: "zzz"}   # 99 is not an item; zzz is not a class
    g = spark.createDataFrame(list(gold.items()), "item_id long, label string")
    res = ds.ds_semisupervised(votes_df(spark), g, CLASSES, ANN, max_iters=4, tol=0.0)
    post, pri, conf, hist = brute_em(VOTES, CLASSES, ANN, 4, gold=gold)
    got = _post_map(res.posterior)
    for i in post:
        np.testing.assert_allclose(got[i], post[i], atol=1e-12)
    assert got[5].sum() == 0.0      # gold outside the classes -> all-zero posterior
    np.testing.assert_allclose(res.ll_history, hist, rtol=1e-12)


def test_posteriors_sum_to_one_and_same_pattern_same_posterior(spark):
    res = ds.ds_unsupervised(votes_df(spark), CLASSES, ANN, max_iters=5, tol=0.0)
    got = _post_map(res.posterior)
    for p in got.values():
        assert abs(p.sum() - 1.0) < 1e-12
    np.testing.assert_array_equal(got[1], got[7])


def test_loglik_non_decreasing_without_smoothing(spark):
    res = ds.ds_unsupervised(votes_df(spark), CLASSES, ANN, max_iters=10, tol=0.0, laplace=0.0)
    h = res.ll_history
    assert all(b >= a - 1e-9 for a, b in zip(h, h[1:]))


def test_convergence_stops_early(spark):
    res = ds.ds_unsupervised(votes_df(spark), CLASSES, ANN, max_iters=200, tol=1e-7)
    assert res.iterations < 200
    assert abs(res.ll_history[-1] - res.ll_history[-2]) < 1e-7


def test_unknown_annotator_raises_in_training_ignored_in_inference(spark):
    v = votes_df(spark)
    with pytest.raises(ValueError):
        ds.build_patterns(v, CLASSES, ["x", "y"])
    res = ds.ds_unsupervised(v, CLASSES, ANN, max_iters=2, tol=0.0)
    extra = votes_df(spark, VOTES + [(1, "new", "c")])
    a = _post_map(ds.e_step(v, res.model, infer=True))
    b = _post_map(ds.e_step(extra, res.model, infer=True))
    np.testing.assert_allclose(a[1], b[1])


def test_infer_is_invariant_to_partitioning(spark):
    v = votes_df(spark)
    res = ds.ds_unsupervised(v, CLASSES, ANN, max_iters=3, tol=0.0)
    a = _post_map(ds.e_step(v.repartition(1), res.model, infer=True))
    b = _post_map(ds.e_step(v.repartition(7, "annotator"), res.model, infer=True))
    for k in a:
        np.testing.assert_array_equal(a[k], b[k])


def test_infer_no_votes_is_softmax_of_priors(spark):
    v = votes_df(spark)
    res = ds.ds_unsupervised(v, CLASSES, ANN, max_iters=2, tol=0.0)
    items = spark.createDataFrame([(1000,)], "item_id long")
    got = _post_map(ds.e_step(v, res.model, items=items, infer=True))[1000]
    lp = np.log(np.maximum(res.model.priors, 1e-12))
    e = np.exp(lp - lp.max())
    np.testing.assert_allclose(got, e / e.sum())


def test_hard_label_ties_margin_and_abstain(spark):
    df = spark.createDataFrame([(1, [0.4, 0.4, 0.2]), (2, [0.1, 0.2, 0.7]), (3, [0.5, 0.2, 0.3])],
                               "item_id long, post array<double>")
    h = {r["item_id"]: r for r in ds.hard_label(df, CLASSES, abstain_thresh=0.45).collect()}
    assert h[1]["pred_label"] == "ABSTAIN" and h[1]["top2_margin"] == 0.0
    assert h[2]["pred_label"] == "c" and abs(h[2]["top2_margin"] - 0.5) < 1e-12
    assert h[3]["pred_label"] == "a"
    one = spark.createDataFrame([(1, [1.0])], "item_id long, post array<double>")
    r = ds.hard_label(one, ["only"]).first()
    assert r["pred_label"] == "only" and r["top2_margin"] == 1.0


def test_majority_modes_and_missing_items(spark):
    v = votes_df(spark)
    pri = ds.priors_from_votes(v, CLASSES)
    items = spark.createDataFrame([(1,), (6,), (42,)], "item_id long")
    mv = _post_map(ds.majority_vote(v, CLASSES, pri, mode="mv", items=items))
    np.testing.assert_allclose(mv[1], [2 / 3, 1 / 3, 0])
    np.testing.assert_allclose(mv[42], pri)      # no votes -> priors
    np.testing.assert_allclose(mv[6], pri)       # only out-of-class votes -> priors
    u = _post_map(ds.majority_vote(v, CLASSES, pri, mode="uniform"))
    np.testing.assert_allclose(u[1], [1 / 3] * 3)


def test_label_conflicts_first_wins(spark):
    df = spark.createDataFrame([(1, "x", "a", 2), (1, "x", "b", 1), (1, "y", "a", 1), (2, "x", "c", 5)],
                               "item_id long, annotator string, label string, row_no int")
    r = ds.label_conflicts(df).collect()
    assert len(r) == 1 and r[0]["first_label"] == "b" and r[0]["n_labels"] == 2


def test_pattern_join(spark):
    res = ds.ds_unsupervised(votes_df(spark), CLASSES, ANN, max_iters=3, tol=0.0)
    post, _, _, _ = brute_em(VOTES, CLASSES, ANN, 3)
    got = _post_map(res.posterior)
    for i in post:
        np.testing.assert_allclose(got[i], post[i], atol=1e-12)
