"""Registered density-clustering queries on TF-IDF document vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from consensa.operators import cluster, metric_join, vectors
from consensa.plans import sqlfrag as S
from consensa.plans.vector_queries import doc_tokens
from consensa.session import cut_lineage, table, written

EPS_GRID = [0.20, 0.25, 0.30, 0.35]
START_EPS = 0.25
CLUSTER_EPS = 0.30
MIN_CLUSTER_SIZE = 3
CORE_MIN_SAMPLES = 2


def doc_vectors(spark, sf):
    """:func:`packed_vectors` in rows of terms: ``(doc, term, w, df)``, and ``members(id, node)``."""
    c, _, n = vectors.term_counts(doc_tokens(spark, sf), "doc_id", "tok", 1, 1, 2, 0.9)
    own, members = vectors.collapse_counts(cut_lineage(c))
    return cut_lineage(vectors.tfidf(own, n)), cut_lineage(members.withColumnRenamed("doc", "id"))


def packed_vectors(spark, sf):
    """Unigram TF-IDF (min_df 2, max_df 0.9), L2-normalised, of one document for each distinct set of counts:
    ``(doc, keys, ws)``, and ``members(id, node)`` of all documents with a kept term."""
    c, n = vectors.packed_counts(doc_tokens(spark, sf), "doc_id", "tok", 1, 1, 2, 0.9)
    own, members = vectors.collapse_counts(written(c, "counts"))
    return vectors.tfidf(own, n), members.withColumnRenamed("doc", "id")


def _nodes(members):
    """The documents compared, with the number of those they stand for."""
    return members.groupBy("node").agg(F.count(F.lit(1)).alias("weight"))


def _of_all(spark, sf, members, values):
    """Values by node for every document.  One without a kept term has no vector and no neighbour."""
    d = table(spark, sf, "documents").select("doc_id")
    return d.join(members.withColumnRenamed("id", "doc_id"), "doc_id", "left").join(values, "node", "left")


def q_eps_neighbors(spark, sf):
    v, members = packed_vectors(spark, sf)
    p = metric_join.expand_copies(cluster.eps_neighbors_sparse(v, max(EPS_GRID)), members)
    return p.select("a", "b", F.round("dist", 6).alias("dist"))


def q_core_distance(spark, sf):
    v, members = packed_vectors(spark, sf)
    p = cluster.eps_neighbors_sparse(v, max(EPS_GRID))
    c = cluster.core_distance(_nodes(members), p, CORE_MIN_SAMPLES)
    return _of_all(spark, sf, members, c).select("doc_id", F.round("core", 6).alias("core_dist"))


def q_density_cluster(spark, sf):
    v, members = packed_vectors(spark, sf)
    p = cluster.eps_neighbors_sparse(v, CLUSTER_EPS)
    lab = cluster.density_cluster(_nodes(members), p, CLUSTER_EPS, 1, MIN_CLUSTER_SIZE)
    return _of_all(spark, sf, members, lab).select("doc_id", F.coalesce("cluster_id", F.lit(cluster.NOISE).cast("long")).alias("cluster_id"))


def q_tune_epsilon(spark, sf):
    v, members = packed_vectors(spark, sf)
    p = cluster.eps_neighbors_sparse(v, max(EPS_GRID))
    # a document without a vector is a node of its own, which nothing is near
    alone = table(spark, sf, "documents").select(F.col("doc_id").alias("id")).join(members, "id", "left_anti")
    nodes = _nodes(members.unionByName(alone.select("id", F.col("id").alias("node"))))
    cands, _ = cluster.tune_epsilon(nodes, p, START_EPS, EPS_GRID, 1, MIN_CLUSTER_SIZE)
    return cands.select("pos", "epsilon", F.round("noise_ratio", 6).alias("noise_ratio"), "n_clusters", "chosen")


QUERIES = {
    "eps_neighbors": q_eps_neighbors,
    "core_distance": q_core_distance,
    "density_cluster": q_density_cluster,
    "tune_epsilon": q_tune_epsilon,
}

_DOC_TOK = f"list_filter(string_split({S.clean_text('text')}, ' '), lambda t: length(t) >= 2)"
_VEC = f"""
    g AS ({S.ngram_rows(_DOC_TOK, 'doc_id', 'documents', 1, 1)}),
    c AS (SELECT doc_id, gram AS term, count(*) AS n FROM g GROUP BY doc_id, gram),
    df AS (SELECT term, count(*) AS df FROM c GROUP BY term),
    nd AS (SELECT count(*) AS n FROM documents),
    k AS (SELECT c.doc_id, c.term, c.n, df.df FROM c JOIN df ON df.term = c.term
          WHERE df.df >= 2 AND df.df <= 0.9 * (SELECT n FROM nd)),
    w0 AS (SELECT doc_id, term, n * (ln((1.0 + (SELECT n FROM nd)) / (1.0 + df)) + 1.0) AS w FROM k),
    v AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM w0),
    nodes AS (SELECT doc_id AS node FROM documents),
    pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, sqrt(greatest(0.0, 2.0 - 2.0 * sum(x.w * y.w))) AS dist
              FROM v x JOIN v y ON x.term = y.term AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id
              HAVING sqrt(greatest(0.0, 2.0 - 2.0 * sum(x.w * y.w))) <= {max(EPS_GRID)})"""


def _labels_sql(eps: float, tag: str) -> str:
    """CTEs computing DBSCAN* labels with min_samples 1 at ``eps`` (recursive reachability)."""
    return f"""
    e_{tag} AS (SELECT a AS src, b AS dst FROM pairs WHERE dist <= {eps} UNION ALL SELECT b, a FROM pairs WHERE dist <= {eps}),
    r_{tag} AS (SELECT node, min(comp) AS comp FROM reach_{tag} GROUP BY node),
    s_{tag} AS (SELECT comp, count(*) AS n FROM r_{tag} GROUP BY comp),
    l_{tag} AS (SELECT r.node, CASE WHEN s.n >= {MIN_CLUSTER_SIZE} THEN r.comp ELSE -1 END AS cluster_id
                FROM r_{tag} r JOIN s_{tag} s ON s.comp = r.comp)"""


def _reach(tag: str, eps: float) -> str:
    return (f"reach_{tag}(node, comp) AS (SELECT node, node FROM nodes UNION "
            f"SELECT p.dst, r.comp FROM reach_{tag} r JOIN (SELECT a AS src, b AS dst FROM pairs WHERE dist <= {eps} "
            f"UNION ALL SELECT b, a FROM pairs WHERE dist <= {eps}) p ON p.src = r.node)")


def _tune_sql() -> str:
    tries = [(0, START_EPS)] + [(i + 1, e) for i, e in enumerate(EPS_GRID)]
    parts = [_VEC]
    for pos, eps in tries:
        parts.append(_reach(f"t{pos}", eps))
        parts.append(_labels_sql(eps, f"t{pos}"))
    stats = " UNION ALL ".join(
        f"SELECT {pos} AS pos, CAST({eps} AS DOUBLE) AS epsilon, avg(CASE WHEN cluster_id = -1 THEN 1.0 ELSE 0.0 END) AS nr, "
        f"count(DISTINCT CASE WHEN cluster_id >= 0 THEN cluster_id END) AS k FROM l_t{pos}" for pos, eps in tries)
    body = ",\n".join(parts) + f""",
    st AS ({stats}),
    init AS (SELECT nr FROM st WHERE pos = 0),
    cand AS (SELECT * FROM st WHERE pos = 0 OR (SELECT nr FROM init) > 0.5),
    best AS (SELECT pos FROM cand ORDER BY nr, k DESC, pos LIMIT 1)
    SELECT CAST(pos AS INTEGER) AS pos, epsilon, round(nr, 6) AS noise_ratio, CAST(k AS BIGINT) AS n_clusters,
           pos = (SELECT pos FROM best) AS chosen FROM cand"""
    return "WITH RECURSIVE " + body


ORACLE = {
    "eps_neighbors": f"WITH {_VEC} SELECT a, b, round(dist, 6) AS dist FROM pairs",
    "core_distance": f"""WITH {_VEC},
    sym AS (SELECT a AS node, dist FROM pairs UNION ALL SELECT b, dist FROM pairs),
    rk AS (SELECT node, dist, row_number() OVER (PARTITION BY node ORDER BY dist) AS rn FROM sym)
    SELECT n.node AS doc_id, round(rk.dist, 6) AS core_dist FROM nodes n
    LEFT JOIN rk ON rk.node = n.node AND rk.rn = {CORE_MIN_SAMPLES}""",
    "density_cluster": "WITH RECURSIVE " + _VEC.strip() + ",\n" + _reach("c", CLUSTER_EPS) + ",\n"
                       + _labels_sql(CLUSTER_EPS, "c") + "\nSELECT node AS doc_id, CAST(cluster_id AS BIGINT) AS cluster_id FROM l_c",
    "tune_epsilon": _tune_sql(),
}
