"""Registered mining, dedup and roll-up queries and oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from consensa.functions import text as T
from consensa.operators import cluster, dedup, lineage, mining
from consensa.plans import sqlfrag as S
from consensa.plans.text_queries import GRID_SQL, phrase_grid_frame
from consensa.session import table

TRACKED_BRAND = "Brand#3"
EXAMPLE_SEED = 42
EXAMPLES_PER_CLUSTER = 5


def embedding_clusters(spark, sf):
    """Cluster labels over embeddings: noise (-1) where vec_id % 7 = 0, else ``label``;
    weight (duplicate count) = vec_id % 5 + 1."""
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.when(F.col("vec_id") % 7 == 0, F.lit(-1)).otherwise(F.col("label")).alias("cluster_id"),
                    (F.col("vec_id") % 5 + 1).alias("count_total"))


EMB_CLUSTERS_SQL = """
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN -1 ELSE label END AS cluster_id, vec_id % 5 + 1 AS count_total
    FROM embeddings
"""


def q_phrase_grid(spark, sf):
    return phrase_grid_frame(spark, sf)


def q_query_hits(spark, sf):
    d = table(spark, sf, "documents")
    return mining.query_hits(d, phrase_grid_frame(spark, sf), min_hits=1)


def q_match_comments(spark, sf):
    patterns = phrase_grid_frame(spark, sf).select(T.query_pattern(F.col("query")))
    c = table(spark, sf, "conversations")
    lines = c.select("conv_id", "turn", F.posexplode(F.split("text", "\n", -1)).alias("pos", "comment"))
    lines = lines.select("conv_id", "turn", (F.col("pos") + 1).alias("line"), "comment")
    return mining.match_comments(lines, patterns).select("conv_id", "turn", "line", "pattern")


def q_tracked_commits(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("file"), F.col("l_orderkey").alias("sha"),
                                             F.col("l_linestatus").alias("branch"),
                                             F.concat(F.lit("supp/"), F.col("l_suppkey").cast("string")).alias("author"),
                                             F.to_date("l_shipdate").alias("date"), F.col("l_returnflag").alias("message"),
                                             F.concat(F.lit("+"), F.col("l_linenumber").cast("string")).alias("patch"),
                                             F.concat(F.lit("https://example.com/commit/"), F.col("l_orderkey").cast("string"))
                                             .alias("url"))
    tracked = table(spark, sf, "part").filter(F.col("p_brand") == TRACKED_BRAND).select(F.col("p_partkey").alias("file"))
    return mining.tracked_commits(li, tracked)


def _supplier_hits(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(F.concat(F.lit("supp/"), F.col("l_suppkey").cast("string")).alias("repo_full_name"),
                     F.col("l_partkey").alias("file"),
                     F.concat("l_returnflag", "l_linestatus").alias("query"))


def q_repo_rollup(spark, sf):
    return mining.repo_rollup(_supplier_hits(spark, sf))


def q_repo_metrics(spark, sf):
    repos = mining.repo_rollup(_supplier_hits(spark, sf)).select("repo_full_name", "total_count")
    s = table(spark, sf, "supplier").filter(F.col("s_suppkey") % 10 != 0)
    metrics = s.select(F.concat(F.lit("supp/"), F.col("s_suppkey").cast("string")).alias("repo_full_name"),
                       F.col("s_nationkey").alias("stars"), F.round("s_acctbal").cast("long").alias("size"))
    return mining.repo_metrics(repos, metrics, {"stars": 0, "size": 0})


def q_comment_lineage(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("comment_id"), F.col("o_orderdate").alias("ts"),
                                          F.col("o_orderkey").alias("sha"), F.col("o_orderstatus").alias("state"))
    return mining.comment_lineage(o).select("comment_id", "intro_sha", "change_sha")


def document_history(spark, sf):
    """Three commits on a file of each document's lines, as unified diffs: one adds it; one removes every third line and
    puts a note behind every third; one puts the lines back."""
    d = table(spark, sf, "documents").select("source", "doc_id", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("l"))
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt"))
    n, r, a = F.size("l"), F.floor((F.size("l") + 1) / 3), F.floor(F.size("l") / 3)
    note = lambda i: F.when(i % 3 == 2, F.concat(F.lit("\n%note "), i.cast("string"))).otherwise(F.lit(""))
    sign = lambda i, s: F.when(i % 3 == 1, F.lit(s)).otherwise(F.lit(" "))
    bodies = [
        (1, F.lit(0), n, F.transform("l", lambda x: F.concat(F.lit("+"), x))),
        (2, n, n - r + a, F.transform("l", lambda x, i: F.concat(sign(i, "-"), x, F.replace(note(i), F.lit("%"), F.lit("+"))))),
        (3, n - r + a, n + a, F.transform("l", lambda x, i: F.concat(sign(i, "+"), x, F.replace(note(i), F.lit("%"), F.lit(" "))))),
    ]
    commits = F.array(*[F.struct(F.lit(ts).alias("ts"), F.concat_ws("-", F.lit(f"c{ts}"), "doc_id").alias("sha"), F.concat(
        F.lit("--- a/"), name, F.lit("\n+++ b/"), name, F.lit(f"\n@@ -{min(ts - 1, 1)},"), old.cast("string"), F.lit(" +1,"), new.cast("string"),
        F.lit(" @@\n"), F.array_join(body, "\n")).alias("patch")) for ts, old, new, body in bodies])
    return d.select(F.col("source").alias("repo"), F.inline(commits))


def q_line_lineage(spark, sf):
    """Every line of every document, seen after the first, second or third commit."""
    d = table(spark, sf, "documents").select("source", "doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("i", "line"))
    seen = d.select(F.concat_ws(":", "doc_id", "i").alias("comment_id"), F.col("source").alias("repo"),
                    F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "line",
                    ((F.col("doc_id") + F.col("i")) % 3 + 1).cast("int").alias("seen_at"))
    return lineage.line_lineage(seen, document_history(spark, sf))


def q_dedup_first(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return dedup.dedup_first(d, "text", "doc_id", ["lang"]).select("doc_id", "lang")


def q_dedup_counts(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return dedup.dedup_counts(d, "text", "doc_id").select("doc_id", "count_total")


def q_broadcast_labels(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    uniq = dedup.dedup_first(d, "text", "doc_id", []).select("text", (F.col("doc_id") % 7).alias("cluster_id"))
    return dedup.broadcast_labels(d, uniq, "text", "cluster_id").select("doc_id", "cluster_id")


def q_cluster_sizes(spark, sf):
    return cluster.cluster_sizes(embedding_clusters(spark, sf))


def q_topic_sizes(spark, sf):
    from consensa.operators import topics
    return topics.topic_sizes(embedding_clusters(spark, sf).withColumnRenamed("cluster_id", "topic"))


def q_noise_ratio(spark, sf):
    return cluster.noise_ratio(embedding_clusters(spark, sf)).select(F.round("noise_ratio", 6).alias("noise_ratio"))


def q_run_report(spark, sf):
    from consensa.sources import io
    rep = cluster.run_report(embedding_clusters(spark, sf),
                             {"epsilon": 0.25, "min_cluster_size": 5, "min_samples": 1})
    path = io.scratch_dir(spark, "report")
    io.write_report(rep, path)
    return spark.read.schema(rep.schema).json(path)


def q_cluster_examples(spark, sf):
    from consensa.operators import topics
    d = table(spark, sf, "documents").select(F.col("lang").alias("cluster_id"), "doc_id", "text")
    ex = topics.cluster_examples(d, "cluster_id", "doc_id", "text", n=EXAMPLES_PER_CLUSTER, seed=EXAMPLE_SEED)
    return ex.select("cluster_id", "doc_id", "example")


QUERIES = {
    "phrase_grid": q_phrase_grid,
    "query_hits": q_query_hits,
    "match_comments": q_match_comments,
    "tracked_commits": q_tracked_commits,
    "repo_rollup": q_repo_rollup,
    "repo_metrics": q_repo_metrics,
    "comment_lineage": q_comment_lineage,
    "line_lineage": q_line_lineage,
    "dedup_first": q_dedup_first,
    "dedup_counts": q_dedup_counts,
    "broadcast_labels": q_broadcast_labels,
    "cluster_sizes": q_cluster_sizes,
    "topic_sizes": q_topic_sizes,
    "noise_ratio": q_noise_ratio,
    "run_report": q_run_report,
    "cluster_examples": q_cluster_examples,
}

_PATTERN = "lower(replace(array_to_string(list_slice(string_split(query, ' '), 1, len(string_split(query, ' ')) - 1), ' '), '\"', ''))"
_ROLLUP = """
    SELECT 'supp/' || CAST(l_suppkey AS VARCHAR) AS repo_full_name, count(*) AS total_count,
           count(DISTINCT l_partkey) AS n_files,
           array_to_string(list_sort(list_distinct(list(l_returnflag || l_linestatus))), ',') AS queries,
           count(DISTINCT l_returnflag || l_linestatus) AS query_count
    FROM lineitem GROUP BY l_suppkey"""

ORACLE = {
    "phrase_grid": GRID_SQL,
    "query_hits": f"""
    WITH g AS ({GRID_SQL}), d AS (SELECT lang, lower(text) AS lt FROM documents),
    h AS (SELECT g.query, count(d.lang) AS hits FROM g LEFT JOIN d ON d.lang = g.language AND contains(d.lt, g.phrase)
          GROUP BY g.query)
    SELECT query, CAST(hits AS BIGINT) AS hits FROM h WHERE hits >= 1""",
    "match_comments": f"""
    WITH g AS ({GRID_SQL}), pats AS (SELECT DISTINCT {_PATTERN} AS pattern FROM g),
    ls AS (SELECT conv_id, turn, string_split(text, chr(10)) AS l FROM conversations),
    ex AS (SELECT conv_id, turn, unnest(l) AS lt, unnest(range(1, len(l) + 1)) AS line FROM ls)
    SELECT conv_id, turn, CAST(line AS INTEGER) AS line, pattern FROM ex, pats
    WHERE pattern <> '' AND contains(lower(lt), pattern)""",
    "tracked_commits": f"""
    SELECT l_partkey AS file, l_orderkey AS sha, l_linestatus AS branch, 'supp/' || CAST(l_suppkey AS VARCHAR) AS author,
           CAST(l_shipdate AS DATE) AS date, l_returnflag AS message, '+' || CAST(l_linenumber AS VARCHAR) AS patch,
           'https://example.com/commit/' || CAST(l_orderkey AS VARCHAR) AS url FROM lineitem
    WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_brand = '{TRACKED_BRAND}')
    QUALIFY row_number() OVER (PARTITION BY l_partkey, l_orderkey ORDER BY l_linestatus, 'supp/' || CAST(l_suppkey AS VARCHAR),
                               CAST(l_shipdate AS DATE), l_returnflag, '+' || CAST(l_linenumber AS VARCHAR)) = 1""",
    "repo_rollup": _ROLLUP,
    "repo_metrics": f"""
    WITH r AS ({_ROLLUP}),
    m AS (SELECT 'supp/' || CAST(s_suppkey AS VARCHAR) AS repo_full_name, s_nationkey AS stars,
                 CAST(round(s_acctbal) AS BIGINT) AS size FROM supplier WHERE s_suppkey % 10 <> 0)
    SELECT r.repo_full_name, r.total_count, coalesce(m.stars, 0) AS stars, coalesce(m.size, 0) AS size,
           m.repo_full_name IS NOT NULL AS has_metrics
    FROM r LEFT JOIN m ON m.repo_full_name = r.repo_full_name""",
    "comment_lineage": """
    WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus,
                      row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders),
    i AS (SELECT * FROM r WHERE rn = 1),
    c AS (SELECT r.o_custkey, min(r.rn) AS crn FROM r JOIN i ON i.o_custkey = r.o_custkey
          WHERE r.rn > 1 AND r.o_orderstatus <> i.o_orderstatus GROUP BY r.o_custkey)
    SELECT i.o_custkey AS comment_id, i.o_orderkey AS intro_sha, r2.o_orderkey AS change_sha
    FROM i LEFT JOIN c ON c.o_custkey = i.o_custkey LEFT JOIN r r2 ON r2.o_custkey = c.o_custkey AND r2.rn = c.crn""",
    "line_lineage": f"""
    WITH l AS (SELECT source, doc_id, unnest(s) AS line, unnest(range(0, len(s))) AS i
               FROM (SELECT source, doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)),
    t AS (SELECT source, doc_id, i, {S.strip_ws('line')} AS text FROM l),
    plus AS (SELECT doc_id, text, 1 AS ts, i + 1 AS number FROM t
             UNION ALL SELECT doc_id, 'note ' || i, 2, i - (i + 1) // 3 + i // 3 + 2 FROM t WHERE i % 3 = 2
             UNION ALL SELECT doc_id, text, 3, i + 1 + i // 3 FROM t WHERE i % 3 = 1),
    minus AS (SELECT DISTINCT doc_id, text FROM t WHERE i % 3 = 1),
    seen AS (SELECT doc_id, i, text, (doc_id + i) % 3 + 1 AS at FROM t),
    ranked AS (SELECT s.doc_id, s.i, s.text, p.ts, p.number, row_number() OVER (PARTITION BY s.doc_id, s.i ORDER BY p.ts DESC, p.number DESC) AS rn
               FROM seen s JOIN plus p ON p.doc_id = s.doc_id AND p.text = s.text AND p.ts <= s.at)
    SELECT r.doc_id || ':' || r.i AS comment_id, 'c' || r.ts || '-' || r.doc_id AS intro_sha, CAST(r.ts AS INT) AS intro_ts,
           CAST(r.number AS BIGINT) AS intro_line, CASE WHEN r.ts = 1 AND m.text IS NOT NULL THEN 'c2-' || r.doc_id END AS change_sha,
           CAST(CASE WHEN r.ts = 1 AND m.text IS NOT NULL THEN 2 END AS INT) AS change_ts
    FROM ranked r LEFT JOIN minus m ON m.doc_id = r.doc_id AND m.text = r.text WHERE r.rn = 1""",
    "dedup_first": "SELECT min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang FROM documents GROUP BY text",
    "dedup_counts": "SELECT min(doc_id) AS doc_id, count(*) AS count_total FROM documents GROUP BY text",
    "broadcast_labels": """
    WITH u AS (SELECT text, min(doc_id) % 7 AS cluster_id FROM documents GROUP BY text)
    SELECT d.doc_id, u.cluster_id FROM documents d JOIN u ON u.text = d.text""",
    "cluster_sizes": f"SELECT cluster_id, count(*) AS size FROM ({EMB_CLUSTERS_SQL}) GROUP BY cluster_id",
    "topic_sizes": f"""SELECT cluster_id AS topic, count(*) AS size_unique, CAST(sum(count_total) AS BIGINT) AS size_total
    FROM ({EMB_CLUSTERS_SQL}) GROUP BY cluster_id""",
    "noise_ratio": f"""SELECT round(coalesce(avg(CASE WHEN cluster_id = -1 THEN 1.0 ELSE 0.0 END), 0), 6) AS noise_ratio
    FROM ({EMB_CLUSTERS_SQL})""",
    "run_report": f"""
    SELECT count(*) AS num_rows, count(DISTINCT cluster_id) AS num_clusters,
           count(DISTINCT CASE WHEN cluster_id >= 0 THEN cluster_id END) AS num_clusters_ex_noise,
           round(coalesce(avg(CASE WHEN cluster_id = -1 THEN 1.0 ELSE 0.0 END), 0), 4) AS noise_fraction,
           CAST(0.25 AS DOUBLE) AS epsilon, 5 AS min_cluster_size, 1 AS min_samples
    FROM ({EMB_CLUSTERS_SQL})""",
    "cluster_examples": f"""
    WITH r AS (SELECT lang AS cluster_id, doc_id, text,
                      row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR) || ':{EXAMPLE_SEED}')) AS rn
               FROM documents)
    SELECT cluster_id, doc_id, {S.collapse_ws('text')} AS example FROM r WHERE rn <= {EXAMPLES_PER_CLUSTER}""",
}
