"""Registered consensus queries and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from consensa.operators import consensus as ds
from consensa.plans import em_sql
from consensa.plans.fixtures import (DOC_ANNOTATORS, DOC_CLASSES, DOC_GOLD_SQL, DOC_VOTES_SQL,
                                     LINE_VOTES_SQL, document_gold, document_votes, lineitem_votes)
from consensa.operators.mining import join_annotators

EM_ITERS = 3          # oracle-checked EM runs a fixed number of iterations (tol = 0)
INFER_ABSTAIN = 0.7


def _r6(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


def _hard_wide(post: DataFrame, classes: list[str], abstain: float | None = None) -> DataFrame:
    h = ds.hard_label(post, classes, abstain)
    h = ds.expand_posterior(h, classes)
    return _r6(h, ["confidence", "top2_margin"])


# ---------------------------------------------------------------- queries
def q_vote_priors(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(ds.vote_priors(document_votes(spark, sf), DOC_CLASSES), ["prior"])


def q_majority_vote(spark: SparkSession, sf: str) -> DataFrame:
    v = document_votes(spark, sf)
    return ds.expand_posterior(ds.majority_vote(v, DOC_CLASSES, mode="mv+priors"), DOC_CLASSES)


def q_hard_label(spark: SparkSession, sf: str) -> DataFrame:
    v = document_votes(spark, sf)
    post = ds.majority_vote(v, DOC_CLASSES, mode="mv+priors")
    h = ds.hard_label(post, DOC_CLASSES)
    return _r6(h.drop("post"), ["confidence", "top2_margin"])


def q_join_annotators(spark: SparkSession, sf: str) -> DataFrame:
    return join_annotators(document_votes(spark, sf))


def q_label_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return ds.label_conflicts(lineitem_votes(spark, sf, with_order=True), order_col="row_no")


def _start_model(spark: SparkSession, sf: str):
    v = document_votes(spark, sf)
    pri = ds.priors_from_votes(v, DOC_CLASSES)
    return v, ds.diagonal_start(DOC_CLASSES, DOC_ANNOTATORS, pri)


def q_ds_estep(spark: SparkSession, sf: str) -> DataFrame:
    v, m0 = _start_model(spark, sf)
    return ds.expand_posterior(ds.e_step(v, m0), DOC_CLASSES)


def q_ds_mstep(spark: SparkSession, sf: str) -> DataFrame:
    v = document_votes(spark, sf)
    res = ds.ds_unsupervised(v, DOC_CLASSES, DOC_ANNOTATORS, max_iters=1, tol=0.0)
    return _r6(res.model.to_frame(spark), ["p"])


def q_ds_loglik(spark: SparkSession, sf: str) -> DataFrame:
    v = document_votes(spark, sf)
    res = ds.ds_unsupervised(v, DOC_CLASSES, DOC_ANNOTATORS, max_iters=EM_ITERS, tol=0.0)
    rows = [(i, float(x)) for i, x in enumerate(res.ll_history)]
    return _r6(spark.createDataFrame(rows, "iteration int, loglik double"), ["loglik"])


def q_ds_unsupervised(spark: SparkSession, sf: str) -> DataFrame:
    v = document_votes(spark, sf)
    res = ds.ds_unsupervised(v, DOC_CLASSES, DOC_ANNOTATORS, max_iters=EM_ITERS, tol=0.0)
    return _hard_wide(res.posterior, DOC_CLASSES)


def q_ds_semisupervised(spark: SparkSession, sf: str) -> DataFrame:
    v = document_votes(spark, sf)
    g = document_gold(spark, sf)
    res = ds.ds_semisupervised(v, g, DOC_CLASSES, DOC_ANNOTATORS, max_iters=EM_ITERS, tol=0.0)
    return _hard_wide(res.posterior, DOC_CLASSES)


def q_ds_infer(spark: SparkSession, sf: str) -> DataFrame:
    v = document_votes(spark, sf)
    res = ds.ds_unsupervised(v, DOC_CLASSES, DOC_ANNOTATORS, max_iters=EM_ITERS, tol=0.0)
    scored = ds.ds_infer(v, res.model, abstain_thresh=INFER_ABSTAIN)
    scored = ds.expand_posterior(scored, DOC_CLASSES)
    return _r6(scored, ["confidence", "top2_margin"])


def q_ds_converge_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    """EM to convergence (tol 1e-7, up to 200 iterations) on the order votes; bench query."""
    v = lineitem_votes(spark, sf)
    res = ds.ds_unsupervised(v, ds.class_list(v))
    h = ds.hard_label(res.posterior, res.model.classes)
    return h.drop("post")


QUERIES = {
    "vote_priors": q_vote_priors,
    "majority_vote": q_majority_vote,
    "hard_label": q_hard_label,
    "join_annotators": q_join_annotators,
    "label_conflicts": q_label_conflicts,
    "ds_estep": q_ds_estep,
    "ds_mstep": q_ds_mstep,
    "ds_loglik": q_ds_loglik,
    "ds_unsupervised": q_ds_unsupervised,
    "ds_semisupervised": q_ds_semisupervised,
    "ds_infer": q_ds_infer,
    # EM to convergence (tol 1e-7, up to 200 iterations): no SQL oracle, rows-only check
    "ds_unsupervised_converged": q_ds_converge_lineitem,
}


# ---------------------------------------------------------------- oracles
def _with(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


_VC = f"WITH v AS ({DOC_VOTES_SQL}), cls AS (SELECT * FROM (VALUES ('bad', 0), ('good', 1)) AS t(label, ord))"

_PRIOR = _VC + """,
 vc AS (SELECT label, count(*) AS n FROM v GROUP BY label),
 tot AS (SELECT count(*) AS n FROM v WHERE label IN (SELECT label FROM cls))
"""

_MV = _PRIOR + """,
 pr AS (SELECT c.label, c.ord, CASE WHEN tot.n > 0 THEN (coalesce(vc.n, 0) + 1.0) / (tot.n + 2) ELSE 0.5 END AS p
        FROM cls c LEFT JOIN vc ON vc.label = c.label CROSS JOIN tot),
 ic AS (SELECT v.item_id, c.label AS t, c.ord, sum(CASE WHEN v.label = c.label THEN 1 ELSE 0 END) AS n, count(*) AS tot
        FROM v CROSS JOIN cls c GROUP BY v.item_id, c.label, c.ord),
 sc AS (SELECT ic.item_id, ic.t, ic.ord, (CAST(ic.n AS DOUBLE) / ic.tot) * greatest(pr.p, 1e-12) AS s
        FROM ic JOIN pr ON pr.label = ic.t),
 post AS (SELECT item_id, t, s / CASE WHEN sum(s) OVER (PARTITION BY item_id) = 0 THEN 1.0
          ELSE sum(s) OVER (PARTITION BY item_id) END AS p FROM sc)
"""


def _oracles() -> dict[str, str]:
    o: dict[str, str] = {}
    o["vote_priors"] = _PRIOR + """
    SELECT c.label, c.ord, CAST(coalesce(vc.n, 0) AS BIGINT) AS n_votes,
           round(CASE WHEN tot.n > 0 THEN (coalesce(vc.n, 0) + 1.0) / (tot.n + 2) ELSE 0.5 END, 6) AS prior
    FROM cls c LEFT JOIN vc ON vc.label = c.label CROSS JOIN tot"""
    o["majority_vote"] = _MV + """
    SELECT item_id, round(max(CASE WHEN t = 'bad' THEN p END), 6) AS p_bad,
           round(max(CASE WHEN t = 'good' THEN p END), 6) AS p_good FROM post GROUP BY item_id"""
    o["hard_label"] = _MV + """,
    ranked AS (SELECT p.item_id, p.t, p.p, row_number() OVER (PARTITION BY p.item_id ORDER BY p.p DESC, c.ord) AS rk
               FROM post p JOIN cls c ON c.label = p.t)
    SELECT r1.item_id, r1.t AS pred_label, round(r1.p, 6) AS confidence, round(r1.p - coalesce(r2.p, 0), 6) AS top2_margin
    FROM ranked r1 LEFT JOIN ranked r2 ON r2.item_id = r1.item_id AND r2.rk = 2 WHERE r1.rk = 1"""
    o["join_annotators"] = f"""
    WITH v AS ({DOC_VOTES_SQL}),
    full_items AS (SELECT item_id FROM v GROUP BY item_id
                   HAVING count(DISTINCT annotator) = (SELECT count(DISTINCT annotator) FROM v))
    SELECT item_id, annotator, label FROM v WHERE item_id IN (SELECT item_id FROM full_items)"""
    o["label_conflicts"] = f"""
    WITH v AS ({LINE_VOTES_SQL})
    SELECT item_id, annotator, count(DISTINCT label) AS n_labels, arg_min(label, row_no) AS first_label
    FROM v GROUP BY item_id, annotator HAVING count(DISTINCT label) > 1"""

    ctes3 = em_sql.em_ctes(DOC_VOTES_SQL, DOC_CLASSES, DOC_ANNOTATORS, EM_ITERS)
    ctes1 = em_sql.em_ctes(DOC_VOTES_SQL, DOC_CLASSES, DOC_ANNOTATORS, 1)
    o["ds_estep"] = _with(ctes1, """
    SELECT item_id, round(max(CASE WHEN t = 'bad' THEN p END), 6) AS p_bad,
           round(max(CASE WHEN t = 'good' THEN p END), 6) AS p_good FROM post_1 GROUP BY item_id""")
    o["ds_mstep"] = _with(ctes1, """
    SELECT 'prior' AS kind, CAST(NULL AS VARCHAR) AS annotator, label AS true_label,
           CAST(NULL AS VARCHAR) AS obs_label, round(p, 6) AS p FROM prior_1
    UNION ALL
    SELECT 'confusion', annotator, t, o, round(p, 6) FROM conf_1""")
    o["ds_loglik"] = _with(ctes3, " UNION ALL ".join(
        f"SELECT CAST(iteration AS INTEGER) AS iteration, round(loglik, 6) AS loglik FROM ll_{i}"
        for i in range(EM_ITERS + 1)))
    o["ds_unsupervised"] = _with(ctes3, "," + em_sql.hard_label_sql(f"post_{EM_ITERS}", DOC_CLASSES)) \
        .replace("\n,", ",\n", 1)
    semi = em_sql.em_ctes(DOC_VOTES_SQL, DOC_CLASSES, DOC_ANNOTATORS, EM_ITERS, gold_sql=DOC_GOLD_SQL)
    o["ds_semisupervised"] = _with(semi, "," + em_sql.hard_label_sql(f"post_{EM_ITERS}", DOC_CLASSES)) \
        .replace("\n,", ",\n", 1)
    inf = ctes3 + em_sql.infer_ctes(EM_ITERS)
    o["ds_infer"] = _with(inf, "," + em_sql.hard_label_sql("ipost", DOC_CLASSES, INFER_ABSTAIN)) \
        .replace("\n,", ",\n", 1)
    return o


ORACLE = _oracles()
