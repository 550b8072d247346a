"""Clustering against brute force, file formats round trips, streaming = batch."""

import itertools
import json
import math
import os
import random

import pytest
from pyspark.sql import types as T
from pyspark.sql import functions as F
from pyspark.sql import types as T

from consensa.operators import cluster, dedup, mining, topics
from consensa.sources import io


def sparse_vectors(spark, n=60, vocab=30, seed=7):
    rnd = random.Random(seed)
    rows = []
    base = [sorted(rnd.sample(range(vocab), 6)) for _ in range(6)]
    for d in range(n):
        terms = set(base[d % 6][: rnd.randint(3, 6)]) | {rnd.randrange(vocab) for _ in range(rnd.randint(0, 3))}
        ws = {t: rnd.random() + 0.1 for t in terms}
        norm = math.sqrt(sum(w * w for w in ws.values()))
        rows += [(d, f"t{t}", w / norm) for t, w in ws.items()]
    df = spark.createDataFrame(rows, "doc long, term string, w double")
    dfreq = df.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.join(dfreq, "term"), rows


def brute_pairs(rows, eps):
    vec = {}
    for d, t, w in rows:
        vec.setdefault(d, {})[t] = w
    out = {}
    for a, b in itertools.combinations(sorted(vec), 2):
        cos = sum(w * vec[b].get(t, 0.0) for t, w in vec[a].items())
        dist = math.sqrt(max(0.0, 2 - 2 * cos))
        if dist <= eps:
            out[(a, b)] = dist
    return out


@pytest.mark.parametrize("eps", [0.3, 0.6, 0.9])
def test_prefix_filter_join_is_exact(spark, eps):
    vec, rows = sparse_vectors(spark)
    got = {(r["a"], r["b"]): r["dist"] for r in cluster.eps_neighbors_sparse(vec, eps).collect()}
    exp = brute_pairs(rows, eps)
    assert set(got) == set(exp) and len(exp) > 0
    for k in exp:
        assert abs(got[k] - exp[k]) < 1e-9


def test_components_and_density(spark):
    nodes = spark.createDataFrame([(i,) for i in range(10)], "node long")
    pairs = spark.createDataFrame([(0, 1, 0.1), (1, 2, 0.1), (2, 3, 0.1), (5, 6, 0.1), (7, 8, 0.5)],
                                  "a long, b long, dist double")
    lab = {r["node"]: r["cluster_id"] for r in cluster.density_cluster(nodes, pairs, 0.2, 1, 3).collect()}
    assert lab == {0: 0, 1: 0, 2: 0, 3: 0, 4: -1, 5: -1, 6: -1, 7: -1, 8: -1, 9: -1}
    lab2 = {r["node"]: r["cluster_id"] for r in
            cluster.density_cluster(nodes.repartition(5), pairs.repartition(3), 0.2, 1, 3).collect()}
    assert lab2 == lab
    # min_samples 2: node 0 has only one neighbour -> not core -> edge 0-1 dropped
    lab3 = {r["node"]: r["cluster_id"] for r in cluster.density_cluster(nodes, pairs, 0.2, 2, 2).collect()}
    assert lab3[0] == -1 and lab3[1] == lab3[2] == 1


def test_tune_epsilon_rules(spark):
    nodes = spark.createDataFrame([(i,) for i in range(6)], "node long")
    pairs = spark.createDataFrame([(0, 1, 0.15), (1, 2, 0.22), (3, 4, 0.3)], "a long, b long, dist double")
    cands, chosen = cluster.tune_epsilon(nodes, pairs, 0.1, [0.2, 0.25, 0.3], 1, 2)
    c = {r["pos"]: r for r in cands.collect()}
    assert c[0]["noise_ratio"] == 1.0
    assert [r["pos"] for r in c.values() if r["chosen"]] == [3]


def test_dedup_first_and_counts(spark):
    df = spark.createDataFrame([(3, "x", "l3"), (1, "x", "l1"), (2, "y", "l2")], "id long, text string, lang string")
    first = {r["text"]: (r["id"], r["lang"]) for r in dedup.dedup_first(df, "text", "id").collect()}
    assert first == {"x": (1, "l1"), "y": (2, "l2")}
    counts = [(r["text"], r["count_total"]) for r in dedup.dedup_counts(df, "text", "id").collect()]
    assert counts == [("x", 2), ("y", 1)]


def test_name_buckets(spark):
    df = spark.createDataFrame([(["fix crash", "login"],), (["bump deps"],), (["zzz"],)], "terms array<string>")
    names = [r[0] for r in df.select(topics.name_from_terms(F.col("terms"))).collect()]
    assert names == ["Bug Fix", "Dependencies / Build", "TBD"]


def test_json_map_array_lines(spark, tmp_path):
    d = tmp_path / "map"
    d.mkdir()
    (d / "a.json").write_text(json.dumps({"f1": {"message": "hello", "sha": "1"}, "f2": {"message": ""},
                                          "f3": {"sha": "3"}}))
    schema = T.StructType([T.StructField("message", T.StringType()), T.StructField("sha", T.StringType())])
    rows = io.read_json_map(spark, str(d), schema).collect()
    assert [(r["id"], r["message"]) for r in rows] == [("f1", "hello")]
    a = tmp_path / "arr"
    a.mkdir()
    (a / "a.json").write_text(json.dumps([{"message": "m0"}, {"message": "m1"}]))
    rows = io.read_json_array(spark, str(a), schema).collect()
    assert [(r["pos"], r["message"]) for r in rows] == [(0, "m0"), (1, "m1")]


def test_hit_files_named_after_query(spark, tmp_path):
    # landed names: spaces as _, ':' as '=' (Spark paths reject ':')
    d = tmp_path / "hits"
    d.mkdir()
    hit = [{"name": "x.py", "path": "src/x.py", "url": "u", "repository": {"name": "r", "full_name": "o/r"}}]
    (d / '"generated_by" language=Python.json').write_text(json.dumps(hit))
    rows = io.read_hit_files(spark, str(d), multiline=True).collect()
    assert rows[0]["query"] == '"generated by" language:Python' and rows[0]["repo_full_name"] == "o/r"


def test_csv_multiline_round_trip(spark):
    df = spark.createDataFrame([(1, 'line one\n  "quoted", line two  '), (2, "")], "id long, comment string")
    path = io.scratch_dir(spark, "t-csv")
    io.write_csv(df, path)
    back = io.read_csv(spark, path, df.schema, required=["id", "comment"])
    assert sorted(tuple(r) for r in back.collect()) == [(1, 'line one\n  "quoted", line two  '), (2, None)] or \
        sorted(tuple(r) for r in back.collect()) == [(1, 'line one\n  "quoted", line two  '), (2, "")]
    with pytest.raises(ValueError):
        io.read_csv(spark, path, df.schema, required=["missing"])


def test_match_comments_and_hits(spark):
    c = spark.createDataFrame([(1, "Generated BY the tool"), (2, "nothing"), (3, "by the way, generated by")],
                              "id long, comment string")
    m = sorted((r["id"], r["pattern"]) for r in mining.match_comments(c, ["generated by", "by the"]).collect())
    assert m == [(1, "by the"), (1, "generated by"), (3, "by the"), (3, "generated by")]


def test_commit_cells_are_chunked_and_round_trip(spark):
    rows = [(1, f"s{i}", "me", f"2024-01-{i + 1:02d}", f"msg {i}", i) for i in range(7)] + [(2, "t0", "you", "2024-02-01", "x", 0)]
    c = spark.createDataFrame(rows, "c long, sha string, author string, date string, message string, o int")
    cells = io.commits_cell(c, ["c"], ["date", "sha"], chunk_rows=2)
    per_key = {r["c"]: r["n"] for r in cells.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert per_key[1] >= 2 and per_key[2] == 1          # key 1 is split into several cells
    path = io.scratch_dir(spark, "t-tsv")
    io.write_csv(cells, path, sep="\t")
    back = io.read_csv(spark, path, cells.schema, sep="\t")
    got = sorted(io.explode_commits(back).collect(), key=lambda r: (r["c"], r["chunk"], r["pos"]))
    assert [(r["c"], r["sha"], r["message"]) for r in got] == [(r[0], r[1], r[4]) for r in rows]   # in order
    chunks = sorted(r["chunk"] for r in cells.filter("c = 1").collect())
    assert chunks == list(range(len(chunks))) and cells.filter("size(from_json(commits, 'array<string>')) > 2").count() == 0


def test_malformed_json_fails(spark):
    path = io.scratch_dir(spark, "t-bad")
    spark.createDataFrame([('{"a": {"message": "x"}}',), ('{"b": {"message": ',), ("",)], "value string") \
        .repartition(3).write.text(path)
    schema = T.StructType([T.StructField("message", T.StringType())])
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        io.read_json_map(spark, path, schema).collect()


def test_array_and_line_forms_drop_empty_messages(spark):
    path, lines = io.scratch_dir(spark, "t-arr"), io.scratch_dir(spark, "t-lines")
    schema = T.StructType([T.StructField("message", T.StringType())])
    spark.createDataFrame([('[{"message": "x"}, {"message": ""}, {}, {"message": "y"}]',)], "value string").write.text(path)
    assert [(r["pos"], r["message"]) for r in io.read_json_array(spark, path, schema).collect()] == [(0, "x"), (3, "y")]
    spark.createDataFrame([('{"message": "x"}',), ("{}",)], "value string").write.text(lines)
    assert [r["message"] for r in io.read_jsonl(spark, lines, schema, message_field="message").collect()] == ["x"]


def test_csv_with_another_header_fails(spark):
    path = io.scratch_dir(spark, "t-hdr")
    io.write_csv(spark.createDataFrame([(1, 2)], "a long, b long"), path)
    with pytest.raises(Exception, match="(?i)header"):
        io.read_csv(spark, path, T.StructType([T.StructField("file_id", T.LongType()), T.StructField("cluster_id", T.LongType())])).collect()


def test_queries_with_a_plus(spark):
    query = '"the and" language:C++'
    path = io.scratch_dir(spark, "t-plus")
    hit = spark.createDataFrame([(query, "n", "p", "u", ("r", "o/r"))],
                                "query string, name string, path string, url string, repository struct<name:string,full_name:string>")
    io.write_hit_files(hit, path)
    assert [r["query"] for r in io.read_hit_files(spark, path).collect()] == [query]


def test_vectors_of_another_dimension_fail(spark):
    from consensa.operators import vectors
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "v array<double>")
    with pytest.raises(Exception, match="dimensions"):
        vectors.load_embeddings(df, "v", 2).collect()


def test_core_distance_is_that_of_the_kth_neighbour(spark):
    nodes = spark.createDataFrame([(0,), (1,), (2,), (3,)], "node long")
    pairs = spark.createDataFrame([(0, 1, 0.1), (0, 2, 0.3), (1, 2, 0.2)], "a long, b long, dist double")
    for k, want in ((0, [0.0] * 4), (1, [0.1, 0.1, 0.2, None]), (2, [0.3, 0.2, 0.3, None])):
        got = cluster.core_distance(nodes, pairs, k).orderBy("node").collect()
        assert [r["core"] for r in got] == want


def test_components_with_a_hub_and_a_chain(spark):
    nodes = spark.createDataFrame([(i,) for i in range(220)], "node long")
    star = [(0, i) for i in range(1, 120)]                 # hub 0: a hot key in the edge join
    chain = [(i, i + 1) for i in range(120, 199)]          # a long chain: many rounds
    edges = spark.createDataFrame(star + chain + [(119, 120)], "a long, b long")
    comp = {r["node"]: r["comp"] for r in cluster.connected_components(nodes, edges).collect()}
    assert all(comp[i] == 0 for i in range(200))
    assert all(comp[i] == i for i in range(200, 220))


def test_block_join_makes_no_rows_of_candidates(spark):
    """Documents that share a rare term and little else are never rows; blocks change nothing."""
    rows = [(d, t, w, f) for d in range(60) for t, w, f in (("rare", 0.6, 60), (f"own{d // 2}", 0.8, 2))]
    vec = spark.createDataFrame(rows, "doc long, term string, w double, df long")
    for block in (7, 1000):
        out = cluster.eps_neighbors_sparse(vec, 0.35, block=block)
        assert sorted((r["a"], r["b"], round(r["dist"], 6)) for r in out.collect()) == [(d, d + 1, 0.0) for d in range(0, 60, 2)]
        assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
