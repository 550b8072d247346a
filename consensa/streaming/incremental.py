"""Incremental forms with Structured Streaming.

Both operators are stateless per row (broadcast patterns / a literal model), so the
only state is the file source's progress in the checkpoint: each landed file is processed
exactly once, and a restart after executor or driver loss resumes from the checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from consensa.operators import consensus as ds
from consensa.functions.text import decode_content
from consensa.operators.comments import extract_comments
from consensa.operators.mining import match_comments


def _run(stream_df: DataFrame, sink: str, checkpoint: str) -> None:
    q = (stream_df.writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()


def stream_match(spark: SparkSession, landing: str, schema: T.StructType, patterns: list[str] | DataFrame,
                 sink: str, checkpoint: str, key_cols: list[str], text_col: str = "text",
                 style: str = "hash", encoded: bool = False) -> DataFrame:
    """New source files -> comments -> (comment, pattern) matches, appended to ``sink``.  With
    ``encoded`` the files' content is base64, as code hosts deliver it."""
    src = spark.readStream.schema(schema).parquet(landing)
    if encoded:
        src = src.withColumn(text_col, decode_content(F.col(text_col)))
    m = match_comments(extract_comments(src, key_cols, text_col, style), patterns)
    _run(m.select(*key_cols, "line", "pattern"), sink, checkpoint)
    return spark.read.parquet(sink)


def stream_score(spark: SparkSession, landing: str, schema: T.StructType, model: ds.DSModel,
                 sink: str, checkpoint: str, abstain_thresh: float | None = None) -> DataFrame:
    """Arriving items carry their votes as ``array<struct<annotator, label>>``; each is scored
    with the fitted model inlined in the plan (inference rules: unknown annotators ignored)."""
    src = spark.readStream.schema(schema).parquet(landing)
    K = model.K
    amap = F.create_map(*[x for i, a in enumerate(model.annotators) for x in (F.lit(a), F.lit(i))])
    cmap = F.create_map(*[x for i, c in enumerate(model.classes) for x in (F.lit(c), F.lit(i))])
    votes = F.transform(F.filter("votes", lambda v: amap[v["annotator"]].isNotNull() & cmap[v["label"]].isNotNull()),
                        lambda v: F.struct(amap[v["annotator"]].alias("a"), cmap[v["label"]].alias("l"),
                                           F.lit(1).cast("long").alias("cnt")))
    scored = src.select("item_id", votes.alias("votes"), F.lit(None).cast("int").alias("gold_idx"))
    post = ds.with_posterior(scored, model, infer=True).select("item_id", "post")
    h = ds.hard_label(post, model.classes, abstain_thresh)
    cols = [F.col("post")[k].alias(f"p_{c}") for k, c in enumerate(model.classes)]
    _run(h.select("item_id", "pred_label", "confidence", "top2_margin", *cols), sink, checkpoint)
    return spark.read.parquet(sink)
