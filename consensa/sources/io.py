"""Readers and writers for the reference's file formats, as Spark jobs.

* JSON object keyed by id, JSON array, JSON lines (1-3)
* headered CSV with multi-line quoted cells (4), TSV with a JSON cell (5)
* directories of hit files whose query is encoded in the path (6)
* prediction tables (7), one text file set per topic (8), one-row run reports (9)

Scratch output always goes under the session's checkpoint folder (shared storage on a
cluster), never to a machine-local temporary folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from consensa.session import cut_lineage, ensure_checkpoint_dir


def scratch_dir(spark: SparkSession, tag: str) -> str:
    """A fresh folder under the checkpoint root for intermediate files."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/io-{tag}-{uuid.uuid4().hex}"


def _require(df: DataFrame, cols: list[str]) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"input must contain columns {sorted(cols)}; missing {missing}")


# ---------------------------------------------------------------------------
# 1-3 JSON
# ---------------------------------------------------------------------------
def read_json_map(spark: SparkSession, path: str, value_schema: T.StructType,
                  message_field: str = "message") -> DataFrame:
    """Files each holding ONE JSON object ``{id: {...}}`` -> one row per key, rows whose
    message is missing or empty dropped.  A single object cannot be split, so every file is
    read whole (one task per file); convert large inputs to JSON lines once."""
    raw = spark.read.text(path, wholetext=True)
    m = _strict_json("value", T.MapType(T.StringType(), value_schema))
    return _with_message(raw.select(F.explode(m).alias("id", "obj")).select("id", "obj.*"), message_field)


def _strict_json(col: str, schema: T.DataType):
    """Parsed JSON; malformed text fails the query, blank text (an empty file) is null."""
    return F.when(F.trim(col) != "", F.from_json(col, schema, {"mode": "FAILFAST"}))


def _with_message(df: DataFrame, message_field: str | None) -> DataFrame:
    if message_field is None:
        return df
    return df.filter(F.col(message_field).isNotNull() & (F.col(message_field) != ""))


def read_json_array(spark: SparkSession, path: str, item_schema: T.StructType,
                    message_field: str | None = "message") -> DataFrame:
    """Files each holding one JSON array -> rows with ``pos`` = position in the array, rows
    whose message is missing or empty dropped (none without ``message_field``)."""
    raw = spark.read.text(path, wholetext=True)
    arr = _strict_json("value", T.ArrayType(item_schema))
    return _with_message(raw.select(F.posexplode(arr).alias("pos", "obj")).select("pos", "obj.*"), message_field)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, message_field: str | None = None) -> DataFrame:
    """JSON lines with an explicit schema (splittable); a malformed line fails the query, rows
    whose ``message_field`` is missing or empty are dropped."""
    return _with_message(spark.read.schema(schema).option("mode", "FAILFAST").json(path), message_field)


# ---------------------------------------------------------------------------
# 4-5 CSV / TSV
# ---------------------------------------------------------------------------
CSV_WRITE = {"header": "true", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false",
             "ignoreTrailingWhiteSpace": "false"}


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.options(**CSV_WRITE).option("sep", sep).mode("overwrite").csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",",
             required: list[str] | None = None) -> DataFrame:
    """Headered CSV/TSV with multi-line quoted cells and an explicit schema; a file whose
    header has other columns than the schema fails, and so does a schema without a required one."""
    df = (spark.read.schema(schema).option("header", "true").option("multiLine", "true")
          .option("enforceSchema", "false")
          .option("quote", '"').option("escape", '"').option("sep", sep).csv(path))
    _require(df, required or [])
    return df


def read_csv_votes(spark: SparkSession, path: str, schema: T.StructType, comment_idx: int = 3,
                   output_idx: int = 6) -> DataFrame:
    """Annotation CSV: the comment is column ``comment_idx`` and the LLM output column
    ``output_idx`` (0-based), as in the reference's files."""
    df = read_csv(spark, path, schema)
    cols = df.columns
    rest = [c for i, c in enumerate(cols) if i not in (comment_idx, output_idx)
            and c not in ("comment", "llm_output")]
    return df.select(F.col(cols[comment_idx]).alias("comment"), F.col(cols[output_idx]).alias("llm_output"), *rest)


COMMIT_SCHEMA = T.ArrayType(T.StructType([
    T.StructField("sha", T.StringType()), T.StructField("author", T.StringType()),
    T.StructField("date", T.StringType()), T.StructField("message", T.StringType())]))


def commits_cell(commits: DataFrame, key: list[str], order_cols: list[str], chunk_rows: int = 256) -> DataFrame:
    """Gather commits into JSON-array cells, one row per (key, chunk).

    ``chunk`` numbers a key's cells from 0 in the order of ``order_cols``: cells in that order, entries
    in theirs, give the key's history.  No cell has more than ``chunk_rows`` entries.  The rows are dealt
    by ranges of (key, order), so a long history is spread over tasks; a chunk ends where a range does."""
    dealt = commits.repartitionByRange(*key, *order_cols).withColumn("_p", F.spark_partition_id())
    dealt = cut_lineage(dealt)  # the ranges are drawn once
    row = F.row_number().over(Window.partitionBy(*key, "_p").orderBy(*order_cols)) - 1
    c = dealt.withColumn("_own", F.floor(row / F.lit(chunk_rows)))
    parts = c.groupBy(*key, "_p").agg((F.max("_own") + 1).alias("_n"))  # a row for each range that a key touches
    begin = parts.select(*key, "_p", (F.sum("_n").over(Window.partitionBy(*key).orderBy("_p")) - F.col("_n")).alias("_b"))
    c = c.join(begin, [*key, "_p"]).withColumn("chunk", F.col("_b") + F.col("_own"))
    order = [F.col(o).alias(f"_o{i}") for i, o in enumerate(order_cols)]
    g = c.groupBy(*key, "chunk").agg(F.array_sort(F.collect_list(F.struct(*order, "sha", "author", "date",
                                                                            "message"))).alias("_c"))
    cell = F.to_json(F.transform("_c", lambda s: F.struct(s["sha"], s["author"], s["date"], s["message"])))
    return g.select(*key, "chunk", cell.alias("commits"))


def explode_commits(df: DataFrame, cell_col: str = "commits") -> DataFrame:
    return df.select("*", F.posexplode(_strict_json(cell_col, COMMIT_SCHEMA)).alias("pos", "_commit")).select(
        *[c for c in df.columns if c != cell_col], "pos", "_commit.*")


# ---------------------------------------------------------------------------
# 6 hit files
# ---------------------------------------------------------------------------
HIT_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("path", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("repository", T.StructType([T.StructField("name", T.StringType()),
                                              T.StructField("full_name", T.StringType())]))])


WRITE_SALT = 8  # writer tasks per output directory: a hot key is written by several tasks


def _salted(df: DataFrame, key: str, salt: int = WRITE_SALT) -> DataFrame:
    """Cluster rows by ``key`` for a partitioned write, each key spread over ``salt`` tasks
    by a row hash, so a key holding a large share of the rows is not written by one task and
    each directory still gets at most ``salt`` files."""
    return df.repartition(key, F.pmod(F.xxhash64(*df.columns), F.lit(salt)))


def write_hit_files(hits: DataFrame, path: str) -> None:
    """Land hits as JSON lines, one directory per query (``query=<escaped query>``)."""
    _salted(hits, "query").write.mode("overwrite").partitionBy("query").json(path)


def read_hit_files(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Hit files -> ``(query, name, path, url, repo_name, repo_full_name)``.

    The query is recovered from the file location: a ``query=`` directory (escaped by the
    writer, so URL-decoded) or, for files named after the query with spaces as ``_`` and
    ``:`` landed as ``=``, from the file name."""
    df = spark.read.schema(HIT_SCHEMA).option("multiLine", str(multiline).lower()).json(path)
    fp = F.col("_metadata.file_path")
    from_dir = F.regexp_extract(fp, r"/query=([^/]*)/", 1)
    from_name = F.regexp_replace(F.regexp_replace(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1),
                                                  "_", " "), "=", ":")
    decoded = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))  # noqa: E731 - a plus is no blank here
    q = F.when(from_dir != "", decoded(decoded(from_dir))).otherwise(decoded(from_name))
    return df.select(q.alias("query"), "name", "path", "url", F.col("repository.name").alias("repo_name"),
                     F.col("repository.full_name").alias("repo_full_name"))


# ---------------------------------------------------------------------------
# 7-9 sinks
# ---------------------------------------------------------------------------
def write_predictions(pred: DataFrame, path: str, fmt: str = "csv") -> None:
    """Prediction rows (id, label, confidence, margin, one ``p_<class>`` per class, 6 dp)."""
    if fmt == "csv":
        write_csv(pred, path)
    else:
        pred.write.mode("overwrite").json(path)


def write_topic_text(docs: DataFrame, path: str, topic_col: str, message_col: str,
                     include_outliers: bool = True, max_lines: int | None = None) -> None:
    """One text file set per topic, one message per line (newlines to spaces, stripped,
    empty messages dropped).  ``max_lines`` caps each topic's preview (a feature of the
    preview files, off by default)."""
    from consensa.functions.text import strip_ws
    m = docs.select(F.col(topic_col).alias("topic"),
                    strip_ws(F.regexp_replace(F.col(message_col), "\n", " ")).alias("value"))
    m = m.filter(F.col("value") != "")
    if not include_outliers:
        m = m.filter(F.col("topic") != -1)
    if max_lines is not None:
        from pyspark.sql import Window
        m = m.withColumn("_rn", F.row_number().over(Window.partitionBy("topic").orderBy("value"))) \
            .filter(F.col("_rn") <= max_lines).drop("_rn")
    _salted(m, "topic").write.mode("overwrite").partitionBy("topic").text(path)


def read_topic_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).text(path).select(F.col("topic").cast("string").alias("topic"),
                                                                 F.col("value").alias("message"))


def write_report(report: DataFrame, path: str) -> None:
    """A one-row report as a single JSON file."""
    report.coalesce(1).write.mode("overwrite").json(path)
