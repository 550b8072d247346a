"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing.

Every stage takes the documents that its predecessor kept and returns those it keeps (the last one: the
packed pieces).  Null, empty and repeated rows, ties and empty tables are what the operators define; a
document is dropped by the quality rules, if other texts have all of its lines, as a near-duplicate of the
least id of its group, or for a benchmark passage, and otherwise kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from consensa.llm.common import BLANKS, read, written
from consensa.llm.decontaminate import mark
from consensa.llm.line_dedup import dedup_lines
from consensa.llm.near_dedup import link
from consensa.llm.packing import pack
from consensa.llm.quality_rules import quality_rules

#: Least similarity of near-duplicates in the corpus, in percent (that of the query op8_near_dedup is its own).
NEAR_PERCENT = 80
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules(docs).where("kept").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines repeated in any other text; n_chars follows the text where lines went.  Near-duplicates
    count as one text and so keep the lines that they share, for the next stage to find them by.  A document of which no
    word is left goes."""
    near = written(link(docs, percent=NEAR_PERCENT).select(*COLUMNS, "component_id"), "near-texts")
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    left = dedup_lines(near, same="component_id").where((F.col("n_removed") == 0) | F.col("text").rlike(f"[^{BLANKS}]"))
    return left.withColumn("n_chars", n_chars).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates: that of the least id."""
    return link(docs, percent=NEAR_PERCENT).where("stays").select(*COLUMNS)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return mark(docs, read(spark, sf_dir, "benchmark")).where(F.size("matches") == 0).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences, with their token ids."""
    return pack(docs)


STAGES = [("quality_rules", quality_stage), ("line_dedup", line_stage), ("near_dedup", near_stage),
          ("decontaminate", benchmark_stage), ("packing", packing_stage)]
#: SimHash and tokens are nothing that SQL expresses; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage's result is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
