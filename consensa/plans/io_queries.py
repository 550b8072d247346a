"""Registered source/sink and streaming queries.

Each writes data derived from the driver's tables to a fresh scratch folder under the
checkpoint root, reads it back with the operator under test, and returns the read-back rows,
so the oracle compares them with the original table.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from consensa.functions import text as TX
from consensa.operators import consensus as ds
from consensa.operators import mining
from consensa.plans import consensus_queries as CQ
from consensa.plans import sqlfrag as S
from consensa.plans.fixtures import DOC_ANNOTATORS, DOC_CLASSES, document_votes
from consensa.plans.mining_queries import _PATTERN
from consensa.plans.text_queries import GRID_SQL, phrase_grid_frame, python_sources
from consensa.plans.text_queries import ORACLE as TEXT_ORACLE
from consensa.session import table
from consensa.sources import io
from consensa.streaming import incremental

BUCKET = 100  # entries per landed JSON object / array file


def _bucketed_json(spark, sf, kind):
    e = table(spark, sf, "events")
    msg = F.when(F.col("user_id") % 10 == 0, F.lit("")).otherwise(F.col("event_type"))
    e = e.select((F.col("event_id") / BUCKET).cast("long").alias("bucket"), "event_id", "user_id",
                 msg.alias("message"))
    if kind == "map":
        val = F.to_json(F.map_from_entries(F.collect_list(F.struct(
            F.col("event_id").cast("string"), F.struct("message", "user_id")))))
    else:
        val = F.to_json(F.array_sort(F.collect_list(F.struct("event_id", "message", "user_id"))))
    g = e.groupBy("bucket").agg(val.alias("value"))
    path = io.scratch_dir(spark, f"json-{kind}")
    g.repartition("bucket").write.partitionBy("bucket").text(path)
    return path


def q_read_json_map(spark, sf):
    path = _bucketed_json(spark, sf, "map")
    schema = T.StructType([T.StructField("message", T.StringType()), T.StructField("user_id", T.LongType())])
    return io.read_json_map(spark, path, schema).select(F.col("id").alias("file_id"), "message")


def q_read_json_array(spark, sf):
    path = _bucketed_json(spark, sf, "array")
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("message", T.StringType())])
    return io.read_json_array(spark, path, schema).select("event_id", "pos", "message")


def q_read_jsonl(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", "props")
    path = io.scratch_dir(spark, "jsonl")
    e.write.json(path)
    return io.read_jsonl(spark, path, e.schema)


CSV_SCHEMA = T.StructType([
    T.StructField("row_no", T.LongType()), T.StructField("doc_id", T.LongType()),
    T.StructField("source", T.StringType()), T.StructField("comment", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("n_chars", T.LongType()),
    T.StructField("llm_output", T.StringType())])


def q_read_csv_votes(spark, sf):
    d = table(spark, sf, "documents")
    rows = d.select(F.col("doc_id").alias("row_no"), "doc_id", "source", F.col("text").alias("comment"), "lang",
                    "n_chars", F.concat(F.lit('{"category": "'), F.col("lang"), F.lit('"}')).alias("llm_output"))
    path = io.scratch_dir(spark, "csv")
    io.write_csv(rows, path)
    back = io.read_csv_votes(spark, path, CSV_SCHEMA)
    return back.select("doc_id", "comment", "llm_output")


TSV_SCHEMA = T.StructType([
    T.StructField("row_no", T.LongType()), T.StructField("filepath", T.StringType()),
    T.StructField("c_custkey", T.LongType()), T.StructField("chunk", T.LongType()),
    T.StructField("html_url", T.StringType()), T.StructField("commits", T.StringType())])


def q_read_tsv_commits(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").cast("string").alias("sha"),
        F.concat(F.lit("cust"), F.col("o_custkey").cast("string")).alias("author"),
        F.col("o_orderdate").cast("string").alias("date"), F.col("o_orderstatus").alias("message"),
        F.col("o_orderdate").alias("_d"), F.col("o_orderkey").alias("_k"))
    cells = io.commits_cell(o, ["c_custkey"], ["_d", "_k"], chunk_rows=4)  # so that histories have several
    rows = cells.select(F.xxhash64("c_custkey", "chunk").alias("row_no"),
                        F.concat(F.lit("cust/"), F.col("c_custkey").cast("string"), F.lit("/orders.txt")).alias("filepath"),
                        "c_custkey", "chunk",
                        F.concat(F.lit("https://example.com/cust/"), F.col("c_custkey").cast("string"),
                                 F.lit("/blob/main/orders.txt")).alias("html_url"), "commits")
    path = io.scratch_dir(spark, "tsv")
    io.write_csv(rows, path, sep="\t")
    back = io.read_csv(spark, path, TSV_SCHEMA, sep="\t", required=["filepath", "html_url", "commits"])
    ex = io.explode_commits(back.select(TX.repo_from_url(F.col("html_url")).alias("repo_full_name"), "chunk", "commits"))
    place = F.row_number().over(Window.partitionBy("repo_full_name").orderBy("chunk", "pos"))
    return ex.select("repo_full_name", "sha", "message", place.alias("place"))


def q_read_hit_files(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "lang", "text")
    pairs = mining.query_hit_pairs(d, phrase_grid_frame(spark, sf))
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt"))
    hits = pairs.select("query", name.alias("name"), F.concat(F.col("source"), F.lit("/"), name).alias("path"),
                        F.concat(F.lit("https://example.com/"), F.col("source"), F.lit("/"), name).alias("url"),
                        F.struct(F.col("source").alias("name"),
                                 F.concat(F.lit("org/"), F.col("source")).alias("full_name")).alias("repository"))
    path = io.scratch_dir(spark, "hits")
    io.write_hit_files(hits, path)
    return io.read_hit_files(spark, path).select("query", "repo_full_name", "path")


def q_write_predictions(spark, sf):
    pred = CQ.q_ds_unsupervised(spark, sf)
    path = io.scratch_dir(spark, "pred")
    io.write_predictions(pred, path, "csv")
    io.write_predictions(pred, path + "-json", "json")
    return io.read_csv(spark, path, pred.schema, required=["item_id", "pred_label", "confidence"])


def q_write_topic_text(spark, sf):
    d = table(spark, sf, "documents")
    path = io.scratch_dir(spark, "topics")
    io.write_topic_text(d, path, "lang", "text")
    return io.read_topic_text(spark, path)


SOURCE_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("content", T.StringType())])


def q_stream_match(spark, sf):
    c = python_sources(spark, sf).select("doc_id", F.base64(F.col("source").cast("binary")).alias("content"))
    patterns = phrase_grid_frame(spark, sf).select(TX.query_pattern(F.col("query")))
    landing = io.scratch_dir(spark, "landing")
    # two arrivals: even documents first, odd ones later
    c.filter(F.col("doc_id") % 2 == 0).write.parquet(landing + "/batch=0")
    c.filter(F.col("doc_id") % 2 == 1).write.parquet(landing + "/batch=1")
    out = incremental.stream_match(spark, landing + "/*", SOURCE_SCHEMA, patterns, io.scratch_dir(spark, "sink"),
                                   io.scratch_dir(spark, "ckpt"), ["doc_id"], "content", encoded=True)
    return out.select("doc_id", "line", "pattern")


ITEM_SCHEMA = T.StructType([
    T.StructField("item_id", T.LongType()),
    T.StructField("votes", T.ArrayType(T.StructType([T.StructField("annotator", T.StringType()),
                                                     T.StructField("label", T.StringType())])))])


def q_stream_score(spark, sf):
    v = document_votes(spark, sf)
    res = ds.ds_unsupervised(v, DOC_CLASSES, DOC_ANNOTATORS, max_iters=CQ.EM_ITERS, tol=0.0)
    items = v.groupBy("item_id").agg(F.collect_list(F.struct("annotator", "label")).alias("votes"))
    landing = io.scratch_dir(spark, "items")
    items.write.parquet(landing)
    out = incremental.stream_score(spark, landing, ITEM_SCHEMA, res.model, io.scratch_dir(spark, "scores"),
                                   io.scratch_dir(spark, "ckpt"), CQ.INFER_ABSTAIN)
    return out.select("item_id", "pred_label", F.round("confidence", 6).alias("confidence"),
                      F.round("top2_margin", 6).alias("top2_margin"),
                      *[F.round(f"p_{c}", 6).alias(f"p_{c}") for c in DOC_CLASSES])


QUERIES = {
    "read_json_map": q_read_json_map,
    "read_json_array": q_read_json_array,
    "read_jsonl": q_read_jsonl,
    "read_csv_votes": q_read_csv_votes,
    "read_tsv_commits": q_read_tsv_commits,
    "read_hit_files": q_read_hit_files,
    "write_predictions": q_write_predictions,
    "write_topic_text": q_write_topic_text,
    "stream_match": q_stream_match,
    "stream_score": q_stream_score,
}

ORACLE = {
    "read_json_map": "SELECT CAST(event_id AS VARCHAR) AS file_id, event_type AS message FROM events "
                     "WHERE user_id % 10 <> 0",
    "read_json_array": f"""SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id // {BUCKET} ORDER BY event_id) - 1
                              AS INTEGER) AS pos,
                          event_type AS message FROM events QUALIFY user_id % 10 <> 0""",
    "read_jsonl": "SELECT event_id, user_id, event_type, value, props FROM events",
    "read_csv_votes": """SELECT doc_id, text AS comment, '{"category": "' || lang || '"}' AS llm_output FROM documents""",
    "read_tsv_commits": "SELECT 'cust/' || CAST(o_custkey AS VARCHAR) AS repo_full_name, CAST(o_orderkey AS VARCHAR) AS sha, "
                        "o_orderstatus AS message, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) "
                        "AS place FROM orders",
    "read_hit_files": f"""WITH g AS ({GRID_SQL})
    SELECT g.query, 'org/' || d.source AS repo_full_name, d.source || '/doc' || CAST(d.doc_id AS VARCHAR) || '.txt' AS path
    FROM g JOIN documents d ON d.lang = g.language AND contains(lower(d.text), g.phrase)""",
    "write_predictions": CQ.ORACLE["ds_unsupervised"],
    "write_topic_text": f"""WITH m AS (SELECT lang AS topic, {S.strip_ws("replace(text, chr(10), ' ')")} AS message FROM documents)
    SELECT topic, message FROM m WHERE message <> ''""",
    "stream_match": f"""
    WITH g AS ({GRID_SQL}), pats AS (SELECT DISTINCT {_PATTERN} AS pattern FROM g),
    found AS ({TEXT_ORACLE["extract_line_comments"]})
    SELECT doc_id, line, pattern FROM found, pats WHERE pattern <> '' AND contains(lower(comment), pattern)""",
    "stream_score": CQ.ORACLE["ds_infer"],
}
