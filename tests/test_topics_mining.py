"""Topic, vector and mining operators on small inline tables."""

import math

import numpy as np
from pyspark.sql import functions as F

from consensa.operators import mining, topics, vectors


def _emb(spark):
    rows = [(0, 0, [1.0, 0.0, 0.0]), (1, 0, [0.9, 0.1, 0.0]), (2, 1, [0.0, 1.0, 0.0]), (3, 1, [0.1, 0.9, 0.0]),
            (4, 2, [0.0, 0.0, 1.0]), (5, 2, [0.0, 0.3, 0.95]), (6, -1, [0.8, 0.2, 0.0]), (7, -1, [0.0, 0.1, 0.9])]
    df = spark.createDataFrame(rows, "vec_id long, topic int, v array<double>")
    return df.withColumn("v", vectors.l2_normalize(F.col("v")))


def test_probabilities_and_outliers(spark):
    d = _emb(spark)
    p, ids = topics.topic_probabilities(d, "topic", "v")
    got = {r["vec_id"]: r for r in p.collect()}
    assert ids == [0, 1, 2]
    for r in got.values():
        assert abs(sum(r["probs"]) - 1.0) < 1e-9
    assert got[6]["best_topic"] == 0 and got[7]["best_topic"] == 2
    for strategy in ("probabilities", "nearest"):
        o = {r["vec_id"]: r["new_topic"] for r in topics.reduce_outliers(d, "topic", "v", strategy).collect()}
        assert o[6] == 0 and o[7] == 2 and o[2] == 1


def test_reduce_topics_merges_closest(spark):
    d = _emb(spark)
    r, mapping = topics.reduce_topics(d, "topic", "v", 2)
    assert len(set(mapping.values())) == 2
    r1, m1 = topics.reduce_topics(d, "topic", "v", 1)
    assert set(m1.values()) == {0}
    assert {x["new_topic"] for x in r1.collect()} == {0, -1}


def test_reduce_dims_and_hybrid(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rnd.normal(size=6)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    red = vectors.reduce_dims(df, "v", 3).collect()
    assert all(len(r["reduced"]) == 3 and abs(math.sqrt(sum(x * x for x in r["reduced"])) - 1) < 1e-9 for r in red)
    assert vectors.reduce_dims(df.limit(0), "v", 3).collect() == []
    h = df.select(vectors.hybrid_vector(F.col("v"), F.col("v")).alias("h")).first()["h"]
    assert len(h) == 12 and abs(sum(x * x for x in h) - 1) < 1e-9


def test_query_hits_zero_kept_when_min_zero(spark):
    docs = spark.createDataFrame([("en", "And The cat"), ("fr", "and the")], "lang string, text string")
    grid = spark.createDataFrame([('"and the" language:en', "and the", "en"), ('"of the" language:en', "of the", "en")],
                                 "query string, phrase string, language string")
    all_q = {r["query"]: r["hits"] for r in mining.query_hits(docs, grid, min_hits=0).collect()}
    assert all_q == {'"and the" language:en': 1, '"of the" language:en': 0}
    assert [r["query"] for r in mining.query_hits(docs, grid).collect()] == ['"and the" language:en']


def test_tracked_commits_branch_order(spark):
    cf = spark.createDataFrame([(1, "s1", "dev"), (1, "s1", "main"), (2, "s2", "dev"), (3, "s3", "main")],
                               "file long, sha string, branch string")
    tracked = spark.createDataFrame([(1,), (2,)], "file long")
    got = {(r["file"], r["sha"]): r["branch"] for r in mining.tracked_commits(cf, tracked, ["main", "dev"]).collect()}
    assert got == {(1, "s1"): "main", (2, "s2"): "dev"}


def test_repo_metrics_defaults_and_lineage(spark):
    repos = spark.createDataFrame([("o/a", 3), ("o/b", 1)], "repo_full_name string, total_count long")
    metrics = spark.createDataFrame([("o/a", 10)], "repo_full_name string, stars long")
    got = {r["repo_full_name"]: (r["stars"], r["has_metrics"]) for r in
           mining.repo_metrics(repos, metrics, {"stars": 0}).collect()}
    assert got == {"o/a": (10, True), "o/b": (0, False)}
    commits = spark.createDataFrame(
        [(1, 1, "a", "x"), (1, 2, "b", "x"), (1, 3, "c", "y"), (1, 4, "d", "z"), (2, 5, "e", "x")],
        "comment_id long, ts long, sha string, state string")
    lin = {r["comment_id"]: (r["intro_sha"], r["change_sha"]) for r in mining.comment_lineage(commits).collect()}
    assert lin == {1: ("a", "c"), 2: ("e", None)}


def test_skew_join_equals_plain_join(spark):
    from consensa.operators.skew import hot_keys, skew_join
    big = spark.createDataFrame([(0 if i % 3 == 0 else i, i) for i in range(300)], "k long, v long")
    small = spark.createDataFrame([(k, f"l{k}") for k in range(0, 300, 2)], "k long, lab string")
    assert hot_keys(big, "k", share=0.1, min_rows=10) == [0]
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = sorted(map(tuple, skew_join(big, small, "k", how, salt=4, share=0.1, min_rows=10).collect()))
        b = sorted(map(tuple, big.join(small, "k", how).collect()))
        assert a == b, how


def test_reduce_dims_matches_numpy_svd(spark):
    rnd = np.random.default_rng(11)
    X = rnd.normal(size=(30, 5)) @ np.diag([5.0, 3.0, 2.0, 1.0, 0.5])
    df = spark.createDataFrame([(i, [float(x) for x in X[i]]) for i in range(30)], "vec_id long, v array<double>")
    got = {r["vec_id"]: np.array(r["reduced"]) for r in vectors.reduce_dims(df, "v", 2).collect()}
    _, _, vt = np.linalg.svd(X, full_matrices=False)
    proj = X @ vt[:2].T
    proj /= np.linalg.norm(proj, axis=1, keepdims=True)
    G = np.array([got[i] for i in range(30)])
    for j in range(2):   # singular vectors are defined up to sign
        sign = np.sign(G[:, j] @ proj[:, j])
        np.testing.assert_allclose(G[:, j], sign * proj[:, j], atol=1e-6)


def test_a_thousand_topics(spark):
    """The plan does not grow with the topics, and merging keeps the greedy order."""
    import numpy as np
    from consensa.operators import topics
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(1000, 8))
    rows = [(i, i, [float(x) for x in v]) for i, v in enumerate(vecs)] + [(1000, -1, [float(x) for x in vecs[7] * 2])]
    df = spark.createDataFrame(rows, "id long, topic int, v array<double>")
    p, ids = topics.topic_probabilities(df, "topic", "v")
    assert len(ids) == 1000 and len(p._jdf.queryExecution().analyzed().toString()) < 60_000
    got = p.filter("id = 1000").first()
    assert got["best_topic"] == 7 and abs(sum(got["probs"]) - 1) < 1e-9
    assert topics.reduce_outliers(df, "topic", "v", "nearest").filter("id = 1000").first()["new_topic"] in ids
    _, mapping = topics.reduce_topics(df.filter("topic < 40"), "topic", "v", 10)
    cents, sizes, want = {i: vecs[i] for i in range(40)}, dict.fromkeys(range(40), 1), {i: i for i in range(40)}
    while len(cents) > 10:
        cos = lambda a, b: cents[a] @ cents[b] / np.linalg.norm(cents[a]) / np.linalg.norm(cents[b])  # noqa: E731, B023
        a, b = max(((a, b) for a in cents for b in cents if a < b), key=lambda x: cos(*x))
        cents[a] = (sizes[a] * cents[a] + sizes[b] * cents.pop(b)) / (sizes[a] + sizes[b])
        sizes[a] += sizes[b]
        want = {k: a if v == b else v for k, v in want.items()}
    assert mapping == want


def test_phrases_against_contains(spark, monkeypatch):
    from consensa.operators import phrases
    monkeypatch.setattr(phrases, "SLICE", 3)  # several automata
    texts = ["a cat sat", "category of CATS", None, "", "at", "ein Kätzchen", "x" * 50]
    words = ["cat", "a", "at", "sat", "ät", "z", "", "category of", "xx", "cat", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    table = spark.createDataFrame([(w,) for w in words], "w string")
    want = sorted((i, w) for i, t in enumerate(texts) for w in {w for w in words if w} if t and w in t)
    for source in (table, words):
        out = phrases.phrase_matches(df, F.col("t"), source)
        assert sorted((r.id, r.pattern) for r in out.collect()) == want
    assert phrases.phrase_matches(df, F.col("t"), []).collect() == []
    clash = phrases.phrase_matches(df.withColumn("pattern", F.lit(1)), F.col("t"), ["cat"])
    assert clash.columns == ["id", "t", "pattern"] and clash.count() == 2


def test_a_million_phrases(spark):
    grid = spark.range(1_000_000).select(F.concat(F.lit("phrase "), F.col("id").cast("string"), F.lit(" end")).alias("phrase"))
    c = spark.createDataFrame([(1, "Phrase 77 END and phrase 999999 end"), (2, "phrase 77")], "id long, comment string")
    out = mining.match_comments(c, grid)
    assert sorted((r.id, r.pattern) for r in out.collect()) == [(1, "phrase 77 end"), (1, "phrase 999999 end")]
    assert len(out._jdf.queryExecution().toString()) < 10_000  # no phrase is in the plan


def test_top_terms_cut_before_they_are_dealt_by_cluster(spark):
    """Each task's best terms alone are dealt by cluster: a join by cluster before would sort whole clusters in a task each."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([(c, [f"t{i % 5}", f"u{i}"]) for c in "ab" for i in range(20)], "cluster string, tok array<string>")
        top = topics.top_terms(vectors.class_tfidf(df, "cluster", "tok", 1, 1), 2)
        plan = top._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "Partial" in plan.split("WindowGroupLimit")[-1]
        assert {r["term"] for r in top.collect()} == {"t0", "t1"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
