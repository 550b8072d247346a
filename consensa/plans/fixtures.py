"""Mappings from the driver's tables to operator inputs.

Each fixture has a Spark form (``DataFrame``) and an independent SQL form (a DuckDB CTE body)
so that every registered query can be checked against a hand-written oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from consensa.session import table

# Fixed values of the fixtures.
DOC_CLASSES = ["bad", "good"]
DOC_ANNOTATORS = ["alpha", "len", "uniq"]
LINE_CLASSES = ["A", "N", "R"]
LINE_ANNOTATORS = ["s0", "s1", "s2"]


# ---------------------------------------------------------------------------
# document votes: three heuristic annotators over documents
# ---------------------------------------------------------------------------
def document_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    letters = F.length(F.regexp_replace("text", "[^A-Za-z]", ""))
    words = F.split(F.lower("text"), " ")
    uniq_ratio = F.size(F.array_distinct(words)).cast("double") / F.size(words).cast("double")
    good_bad = lambda cond: F.when(cond, F.lit("good")).otherwise(F.lit("bad"))
    votes = d.select(
        F.col("doc_id").alias("item_id"),
        F.array(
            F.struct(F.lit("len").alias("annotator"), good_bad(F.col("n_chars") >= 1000).alias("label")),
            F.struct(F.lit("alpha").alias("annotator"),
                     good_bad(letters >= F.lit(0.75) * F.col("n_chars")).alias("label")),
            F.struct(F.lit("uniq").alias("annotator"),
                     F.when(F.col("doc_id") % 10 == 0, F.lit(None).cast("string"))
                     .otherwise(good_bad(uniq_ratio >= F.lit(0.6))).alias("label")),
        ).alias("v"))
    return (votes.select("item_id", F.inline("v"))
            .filter(F.col("label").isNotNull()))


DOC_VOTES_SQL = """
    SELECT doc_id AS item_id, 'len' AS annotator,
           CASE WHEN n_chars >= 1000 THEN 'good' ELSE 'bad' END AS label
    FROM documents
    UNION ALL
    SELECT doc_id, 'alpha',
           CASE WHEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) >= 0.75 * n_chars
                THEN 'good' ELSE 'bad' END
    FROM documents
    UNION ALL
    SELECT doc_id, 'uniq',
           CASE WHEN CAST(len(list_distinct(string_split(lower(text), ' '))) AS DOUBLE)
                     / CAST(len(string_split(lower(text), ' ')) AS DOUBLE) >= 0.6
                THEN 'good' ELSE 'bad' END
    FROM documents WHERE doc_id % 10 <> 0
"""


def document_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("item_id"),
        F.when(F.col("quality") == 1, "good").otherwise("bad").alias("label"))


DOC_GOLD_SQL = """
    SELECT doc_id AS item_id, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS label FROM labels
"""


# ---------------------------------------------------------------------------
# lineitem votes: orders voted on by three supplier groups (repeated votes)
# ---------------------------------------------------------------------------
def lineitem_votes(spark: SparkSession, sf_dir: str, with_order: bool = False) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    cols = [F.col("l_orderkey").alias("item_id"),
            F.concat(F.lit("s"), (F.col("l_suppkey") % 3).cast("string")).alias("annotator"),
            F.col("l_returnflag").alias("label")]
    if with_order:
        # line numbers repeat within an order: the full row order breaks ties
        cols.append(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").alias("row_no"))
    return li.select(*cols)


LINE_VOTES_SQL = """
    SELECT l_orderkey AS item_id, 's' || CAST(l_suppkey % 3 AS VARCHAR) AS annotator,
           l_returnflag AS label,
           {'l_linenumber': l_linenumber, 'l_partkey': l_partkey, 'l_suppkey': l_suppkey,
            'l_returnflag': l_returnflag} AS row_no
    FROM lineitem
"""
