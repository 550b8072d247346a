"""Quality classifier: random Fourier features, ridge regression and isotonic calibration.

Statistics of every whole text are written once as a narrow table.  Of the labelled rows at most
TRAIN_ROWS (those of the smallest hash of their id) train the model: their statistics are standardised,
mapped to random Fourier features (a Gaussian kernel's approximation), and every task sums its part of the
normal equations.  The sums of two halves solve the ridge regression three times: on either half, whose
scores of the other half fit the isotonic calibration, and on both, which scores all documents.

Defined cases: null text counts as empty and is scored like any other; repeated rows get equal scores; a
label given more than once counts as 1 if most are 1, ties included; null labels are left out; without a
labelled row every score is 0.5, with one class alone it is that class; an empty table gives an empty
result; other columns do not enter.  Labels, language, source and id are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from consensa.llm.common import Words, chunks, read, text_buffers, text_or_empty, written

FEATURES = 256
RIDGE = 1e-3
WIDTH = 3.0  # of the kernel, in standard deviations of the statistics
SEED = 7
#: Bound of the training sample; all other work covers all rows.
TRAIN_ROWS = 20_000
THRESHOLD = 0.7

_CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "symbol": b"#*$%&|<>=+~^_\\@{}[]",
            "sentence": b".!?", "exclaim": b"!", "comma": b",;:", "quote": b"\"'()", "space": b" \t\r\x0b\x0c",
            "newline": b"\n", "wide": range(128, 256), "pipe": b"|"}
STATISTICS = [*_CLASSES, "log_bytes", "log_words", "word_mean", "word_spread", "long_words", "distinct_words", "same_next",
              "distinct_pairs", "distinct_lines", "words_per_line"]


def statistics(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each text."""
    docs = len(offsets) - 1
    lo, hi = int(offsets[0]), int(offsets[-1])
    b, off = buf[lo:hi], offsets - lo
    size = np.diff(off).astype(np.float64)
    safe = np.maximum(size, 1)
    out = np.zeros((docs, len(STATISTICS)))
    of_doc = np.repeat(np.arange(docs), np.diff(off))
    seen = np.bincount(of_doc * 256 + b, minlength=docs * 256).reshape(docs, 256)
    for j, members in enumerate(_CLASSES.values()):
        out[:, j] = seen[:, list(members)].sum(1) / safe
    w = Words(buf, offsets)
    n = np.diff(w.first).astype(np.float64)
    many = np.maximum(n, 1)
    length = (w.end - w.start).astype(np.float64)
    per_doc = lambda x: np.bincount(w.doc, weights=x, minlength=docs)
    mean = per_doc(length) / many

    def distinct(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        return np.bincount(doc[new], minlength=docs)

    pairs, inside = w.windows(2)
    next_same = np.zeros(len(w.hash), bool)
    if len(w.hash) > 1:
        next_same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    data = b.tobytes()
    lines = [data[s:e].split(b"\n") for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
    rest = [np.log1p(size), np.log1p(n), mean, np.sqrt(np.maximum(per_doc(length * length) / many - mean ** 2, 0)),
            per_doc((length > 12).astype(np.float64)) / many, distinct(w.hash, w.doc) / many, per_doc(next_same.astype(np.float64)) / many,
            distinct(pairs[inside], w.doc[:len(pairs)][inside]) / np.maximum(n - 1, 1),
            np.array([len(set(x)) / len(x) for x in lines]), np.log1p(n / np.array([len(x) for x in lines]))]
    out[:, len(_CLASSES):] = np.stack(rest, 1)
    return out


def with_statistics(docs: DataFrame, key: str, text: str) -> DataFrame:
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for batch in batches:
            buf, off = text_buffers(batch.column(1))
            for i, j in chunks(np.diff(off)):
                x = statistics(buf, off[i:j + 1])
                flat = pa.array(x.ravel())
                ends = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(ends, flat)],
                                                 names=["key", "x"])

    return docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text")).mapInArrow(
        run, f"key {key_type}, x array<double>")


class Mapping:
    """Statistics to random Fourier features; a bounded set of numbers, made again from the seed."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, features: int = FEATURES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.w = rng.normal(0, 1 / WIDTH, (len(mean), features))
        self.b = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        z = np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b))
        return np.hstack([z, np.ones((len(z), 1))])


def rows_of(batch, column: int) -> np.ndarray:
    values = batch.column(column).flatten().to_numpy(zero_copy_only=False)
    return values.reshape(batch.num_rows, -1)


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: mean scores and mean labels of the blocks, both rising."""
    order = np.argsort(score, kind="stable")
    values, index = np.unique(score[order], return_inverse=True)
    weight = np.bincount(index).astype(np.float64)
    mean = np.bincount(index, weights=label[order]) / weight
    stack: list[list[float]] = []
    for v, m, w in zip(values.tolist(), mean.tolist(), weight.tolist(), strict=True):
        stack.append([v, m, w])
        while len(stack) > 1 and stack[-2][1] >= stack[-1][1]:
            v2, m2, w2 = stack.pop()
            v1, m1, w1 = stack.pop()
            stack.append([(v1 * w1 + v2 * w2) / (w1 + w2), (m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2])
    return np.array([x[0] for x in stack]), np.array([x[1] for x in stack])


def fit(train: DataFrame, tasks: int = 8):
    """Function from statistics to scores.  ``train``: x, y (0 or 1), half (0 or 1); at most TRAIN_ROWS rows."""
    if train.limit(1).count() == 0:
        return lambda x: np.full(len(x), 0.5)
    train = train.coalesce(tasks)
    k = len(STATISTICS)
    moments = train.select(*[f(F.get("x", F.lit(i))).alias(f"{n}{i}") for n, f in (("m", F.avg), ("s", F.stddev_pop))
                             for i in range(k)]).first()
    mapping = Mapping(np.array([moments[f"m{i}"] for i in range(k)]), np.array([moments[f"s{i}"] for i in range(k)]))
    size = FEATURES + 1

    def sums(batches: Iterator) -> Iterator:
        import pyarrow as pa
        g, r = np.zeros((2, size, size)), np.zeros((2, size))
        for batch in batches:
            z, y, half = mapping(rows_of(batch, 0)), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for h in (0, 1):
                own = z[half == h]
                g[h] += own.T @ own
                r[h] += own.T @ y[half == h]
        for h in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array([h], pa.int32()), pa.array([g[h].tobytes()], pa.binary()),
                                              pa.array([r[h].tobytes()], pa.binary())], names=["half", "g", "r"])

    g, r = np.zeros((2, size, size)), np.zeros((2, size))
    ordered = train.select("x", F.col("y").cast("double").alias("y"), F.col("half").cast("int").alias("half"))
    for row in ordered.mapInArrow(sums, "half int, g binary, r binary").collect():  # two rows a task
        g[row.half] += np.frombuffer(row.g).reshape(size, size)
        r[row.half] += np.frombuffer(row.r)

    def solved(gram: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.linalg.solve(gram + (RIDGE * max(gram[-1, -1], 1.0) + 1e-9) * np.eye(size), right)

    halves = [solved(g[1], r[1]), solved(g[0], r[0])]  # for the other half
    whole = solved(g.sum(0), r.sum(0))
    rows = ordered.collect()  # at most TRAIN_ROWS
    z, y = mapping(np.array([x.x for x in rows])), np.array([x.y for x in rows])
    other = np.array([x.half for x in rows])
    at, level = isotonic(np.where(other == 0, z @ halves[0], z @ halves[1]), y)
    return lambda x: np.interp(mapping(x) @ whole, at, level)


def score(docs: DataFrame, labels: DataFrame, learnt_from, key: str = "doc_id", text: str = "text",
          label: str = "quality", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """key and score (0 to 1) of every row of ``docs``; learns from labels whose key ``learnt_from`` holds for."""
    facts = written(with_statistics(docs, key, text), "statistics")
    known = (labels.select(F.col(key).alias("key"), F.col(label).cast("double").alias("y"))
             .where(F.col("y").isNotNull() & learnt_from(F.col("key")))
             .groupBy("key").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
             .withColumn("rank", F.xxhash64("key")).orderBy("rank", "key").limit(train_rows))
    one_each = facts.join(known, "key").groupBy("key").agg(
        F.min_by("x", "x").alias("x"), F.first("y").alias("y"), (F.first("rank").bitwiseAND(F.lit(1))).alias("half"))
    model = fit(written(one_each, "training"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model(rows_of(batch, 1)))], names=[key, "score"])

    return facts.mapInArrow(run, f"`{key}` {facts.schema['key'].dataType.simpleString()}, score double")


def q_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = lambda c: F.crc32(c.cast("string").cast("binary")) % 4
    out = score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), lambda c: fold(c) != 2)
    return out.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op9_quality_classifier": q_quality_classifier}
ORACLE: dict[str, str] = {}
