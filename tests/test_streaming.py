"""Structured Streaming forms: equal to the batch operator, and each landed file is
processed once across restarts (progress lives in the checkpoint)."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from consensa.operators import consensus as ds
from consensa.operators import mining
from consensa.operators.comments import extract_comments
from consensa.sources import io
from consensa.streaming import incremental

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                       T.StructField("text", T.StringType())])
PATTERNS = ["generated by", "by the"]


def test_stream_match_equals_batch_and_resumes(spark):
    rows = [(1, 0, "# Generated by the tool\nx = 'by the'"), (2, 0, "nothing here"), (3, 1, "y = 1\nz  # made by the hand")]
    df = spark.createDataFrame(rows, SCHEMA)
    landing, sink, ckpt = (io.scratch_dir(spark, t) for t in ("land", "sink", "ckpt"))
    df.filter("conv_id < 3").write.parquet(landing + "/b=0")
    out1 = incremental.stream_match(spark, landing + "/*", SCHEMA, PATTERNS, sink, ckpt, ["conv_id", "turn"])
    n1 = out1.count()
    # a restart with no new file adds nothing
    assert incremental.stream_match(spark, landing + "/*", SCHEMA, PATTERNS, sink, ckpt, ["conv_id", "turn"]).count() == n1
    df.filter("conv_id = 3").write.parquet(landing + "/b=1")
    out3 = incremental.stream_match(spark, landing + "/*", SCHEMA, PATTERNS, sink, ckpt, ["conv_id", "turn"])
    lines = extract_comments(df, ["conv_id", "turn"], "text")
    batch = mining.match_comments(lines, PATTERNS).select("conv_id", "turn", "line", "pattern")
    assert sorted(map(tuple, out3.collect())) == sorted(map(tuple, batch.collect()))


def test_stream_score_equals_batch(spark):
    votes = spark.createDataFrame([(1, "x", "a"), (1, "y", "a"), (2, "x", "b"), (2, "y", "a"), (3, "x", "b")],
                                  "item_id long, annotator string, label string")
    res = ds.ds_unsupervised(votes, ["a", "b"], ["x", "y"], max_iters=3, tol=0.0)
    items = votes.groupBy("item_id").agg(F.collect_list(F.struct("annotator", "label")).alias("votes"))
    landing = io.scratch_dir(spark, "items")
    items.write.parquet(landing)
    schema = T.StructType([T.StructField("item_id", T.LongType()),
                           T.StructField("votes", T.ArrayType(T.StructType([
                               T.StructField("annotator", T.StringType()), T.StructField("label", T.StringType())])))])
    out = incremental.stream_score(spark, landing, schema, res.model, io.scratch_dir(spark, "s"),
                                   io.scratch_dir(spark, "c"))
    got = {r["item_id"]: (r["pred_label"], r["p_a"]) for r in out.collect()}
    batch = ds.expand_posterior(ds.ds_infer(votes, res.model), ["a", "b"], digits=None)
    exp = {r["item_id"]: (r["pred_label"], r["p_a"]) for r in batch.collect()}
    assert got.keys() == exp.keys()
    for k in exp:
        assert got[k][0] == exp[k][0] and abs(got[k][1] - exp[k][1]) < 1e-12
