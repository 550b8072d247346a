"""Boundary cases listed in the survey: empty input, null/blank text, one class, one
annotator, items without votes, all noise."""

import numpy as np
from pyspark.sql import functions as F

from consensa.functions import text as T
from consensa.operators import cluster, consensus as ds


def test_empty_votes(spark):
    v = spark.createDataFrame([], "item_id long, annotator string, label string")
    res = ds.ds_unsupervised(v, ["a", "b"], ["x"], max_iters=5, tol=1e-7)
    assert res.posterior.count() == 0
    assert ds.majority_vote(v, ["a", "b"]).count() == 0
    r = {x["label"]: x["prior"] for x in ds.vote_priors(v, ["a", "b"]).collect()}
    assert r == {"a": 0.5, "b": 0.5}


def test_one_class_and_one_annotator(spark):
    v = spark.createDataFrame([(1, "x", "a"), (2, "x", "a")], "item_id long, annotator string, label string")
    res = ds.ds_unsupervised(v, ["a"], ["x"], max_iters=3, tol=0.0)
    h = ds.hard_label(res.posterior, ["a"]).collect()
    assert all(r["pred_label"] == "a" and r["confidence"] == 1.0 and r["top2_margin"] == 1.0 for r in h)


def test_items_without_votes_get_priors(spark):
    v = spark.createDataFrame([(1, "x", "a"), (1, "y", "b"), (2, "x", "a")], "item_id long, annotator string, label string")
    items = spark.createDataFrame([(1,), (2,), (3,)], "item_id long")
    res = ds.ds_unsupervised(v, ["a", "b"], ["x", "y"], max_iters=2, tol=0.0, items=items)
    post = {r["item_id"]: np.array(r["post"]) for r in res.posterior.collect()}
    assert set(post) == {1, 2, 3}
    # the last E-step gives an item without votes the priors in effect at that step
    assert abs(post[3].sum() - 1.0) < 1e-12


def test_all_noise_and_empty_labels(spark):
    nodes = spark.createDataFrame([(i,) for i in range(4)], "node long")
    pairs = spark.createDataFrame([], "a long, b long, dist double")
    lab = cluster.density_cluster(nodes, pairs, 0.3, 1, 2).collect()
    assert {r["cluster_id"] for r in lab} == {-1}
    empty = spark.createDataFrame([], "cluster_id int")
    assert cluster.noise_ratio(empty).first()["noise_ratio"] == 0.0


def test_null_and_blank_text(spark):
    df = spark.createDataFrame([(None,), ("",), ("   ",)], "s string")
    out = df.select(T.normalize_message(F.col("s")).alias("m"), F.size(T.word_tokens(F.col("s"))).alias("n"),
                    T.parse_llm_label(F.col("s")).alias("l")).collect()
    assert all(r["m"] is None for r in out)
    assert [r["n"] for r in out] == [0, 0, 0]
    assert all(r["l"] is None for r in out)
