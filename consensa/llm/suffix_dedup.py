"""Repeated byte strings by distributed prefix doubling over anchored positions.

A byte is removed if a string of LENGTH bytes covers it that starts anywhere else as well.  Suffixes are
compared by their first LENGTH bytes only, in three steps of growing prefixes, and a position leaves as
soon as its prefix is unique or known to be repeated past the threshold:

1. Anchors.  Of the positions in a window of WINDOW, the one whose GRAM bytes hash lowest is the window's
   anchor, the leftmost on a tie; equal strings have their anchors in equal places.  All starts whose window
   has the same anchor form a run.  An anchor's first rank is its prefix of the bytes that a string of any of
   the run's starts holds from the anchor on.  A run whose rank is unique holds no repeated start.
2. The prefix grows to what all of the run's strings cover together, backwards to the run's first start
   and onwards to its last string's end.  Runs of which that is equal are repeated in all their starts.
3. What is left are the runs at the borders of repeated passages.  Of every distinct string of step 2 one
   run is cut into blocks of BLOCK starts, counted from the anchor, which are ranked in the same two ways: by
   the bytes that all of a block's strings hold (LENGTH - BLOCK + 1), and by those that they cover together.
4. Of the blocks that are left, each start is spelt out, with its prefix of the whole LENGTH bytes.

Ranks are 128-bit hashes of the prefixes (64 bits where a false hit only costs work), so a rank pair is
equal where the bytes are, and Spark groups them by sorting its shuffle.  Only runs and starts travel; the
texts of documents with a repeated rank are read once more to spell out starts, and to take the bytes away.
Counts are summed up before shuffling and joined back, so copies by the thousand meet in no single task.

Defined cases: null text counts as empty; texts shorter than LENGTH lose nothing; a repeated row repeats all
its strings, so each of the rows loses all of them; a text over PIECE bytes is passed in overlapping pieces;
runs of one byte make each position an anchor, which costs rows but loses nothing; an empty table gives an
empty result.  Rows are told apart by a 128-bit hash of key and text, so null keys are fine; other columns
do not enter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from consensa.llm.common import read, text_or_empty, written

LENGTH = 400
GRAM = 8
#: Starts of a block; a power of two under the window.
BLOCK = 16
#: Starts of a longer text that are looked at together.
PIECE = 4_000_000


def window_of(length: int) -> int:
    """The largest power of two that leaves the first rank a third of the length."""
    w = 1
    while 2 * w <= length * 2 // 3 and 2 * w + GRAM <= length:
        w *= 2
    return w


def row_id(key: str, text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), F.col(key), text).alias("k2")]


def runs(data: bytes, length: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First start, last start and anchor of every run of starts with the same anchor."""
    firsts, lasts, anchors = [], [], []
    for begin in range(0, len(data) - length + 1, PIECE):
        b = np.frombuffer(data, np.uint8)[begin:begin + PIECE + length - 1]
        starts = len(b) - length + 1
        h = np.zeros(starts + window - 1, np.uint64)
        for k in range(GRAM):
            h |= b[k:k + len(h)].astype(np.uint64) << np.uint64(8 * k)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        h = (h & np.uint64(~((1 << 24) - 1) & (1 << 64) - 1)) | np.arange(len(h), dtype=np.uint64)  # leftmost on a tie
        step = 1
        while step < window:
            h = np.minimum(h[:-step], h[step:])
            step *= 2
        anchor = (h & np.uint64((1 << 24) - 1)).astype(np.int64)
        new = np.flatnonzero(np.diff(anchor)) + 1
        first = np.concatenate([[0], new])
        firsts.append(first + begin)
        lasts.append(np.concatenate([new - 1, [starts - 1]]) + begin)
        anchors.append(anchor[first] + begin)
    if not firsts:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(firsts), np.concatenate(lasts), np.concatenate(anchors)


def removed(data: bytes, spans: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal runs that ``spans`` cover, and the bytes beside them."""
    merged: list[list[int]] = []
    for s, e in sorted(spans):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    rest, at = [], 0
    for s, e in merged:
        rest.append(data[at:s])
        at = e
    rest.append(data[at:])
    return [tuple(x) for x in merged], b"".join(rest)


def _ranked(length: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        window = window_of(length)
        rank = length - window + 1
        kind = pa.struct([("s", pa.int64()), ("e", pa.int64()), ("a", pa.int64()), ("f", pa.int64()),
                          ("g1", pa.int64()), ("g2", pa.int64())])
        for batch in batches:
            rows, sizes = [], []
            for text in batch.column(2):
                data = text.as_py().encode()
                sizes.append(len(data))
                first, last, anchor = runs(data, length, window)
                flat = np.zeros((len(first), 6), np.int64)
                flat[:, 0], flat[:, 1], flat[:, 2] = first, last, anchor
                short = b"".join([xxhash.xxh3_64_digest(data[a:a + rank]) for a in anchor.tolist()])
                long = b"".join([xxhash.xxh3_128_digest(data[s:e + length]) for s, e in
                                 zip(first.tolist(), last.tolist(), strict=True)])
                flat[:, 3] = np.frombuffer(short, np.int64)
                flat[:, 4:] = np.frombuffer(long, np.int64).reshape(-1, 2)
                rows.append(flat)
            flat = np.concatenate(rows) if rows else np.zeros((0, 6), np.int64)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
            structs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(6)], fields=list(kind))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), structs)],
                names=["k1", "k2", "n_bytes", "runs"])
    return run


def _blocks(length: int, block: int):
    """The runs that are asked for, cut into blocks counted from their anchors."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash
        for batch in batches:
            texts, wanted = batch.column(2), batch.column(3).to_pylist()
            rows, ranks, strings = [], [], []
            for i, own in enumerate(wanted):
                data = texts[i].as_py().encode()
                k1, k2 = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                for r in own:
                    for k in range((r["a"] - r["e"]) // block, (r["a"] - r["s"]) // block + 1):
                        top = r["a"] - k * block  # the block's last start, if the run goes so far
                        s, e = max(r["s"], top - block + 1), min(r["e"], top)
                        ranks.append(xxhash.xxh3_64_digest(data[top:top - block + 1 + length]))
                        strings.append(xxhash.xxh3_128_digest(data[s:e + length]))
                        rows.append((k1, k2, s, e, r["n"]))
            flat = np.array(rows, np.int64).reshape(-1, 5)
            g = np.frombuffer(b"".join(strings), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(np.ascontiguousarray(flat[:, c])) for c in range(5)), pa.array(np.frombuffer(b"".join(ranks), np.int64)),
                 *(pa.array(np.ascontiguousarray(g[:, c])) for c in (0, 1))], names=["k1", "k2", "s", "e", "n", "f", "g1", "g2"])
    return run


def _spelt(length: int):
    """The starts that are asked for, each with its string's rank."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash
        for batch in batches:
            texts, wanted = batch.column(2), batch.column(3).to_pylist()
            rows, strings = [], []
            for i, own in enumerate(wanted):
                data = texts[i].as_py().encode()
                k1, k2 = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                for r in own:
                    for s in range(r["s"], r["e"] + 1):
                        rows.append((k1, k2, s, r["n"]))
                        strings.append(xxhash.xxh3_128_digest(data[s:s + length]))
            flat = np.array(rows, np.int64).reshape(-1, 4)
            h = np.frombuffer(b"".join(strings), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(flat[:, c])) for c in range(4)),
                                              *(pa.array(np.ascontiguousarray(h[:, c])) for c in (0, 1))],
                                             names=["k1", "k2", "s", "n", "h1", "h2"])
    return run


def _cut(batches: Iterator) -> Iterator:
    import pyarrow as pa
    for batch in batches:
        spans, kept = [], []
        for text, own in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
            gone, rest = removed(text.as_py().encode(), [(x["s"], x["e"]) for x in own])
            spans.append([{"start": s, "end": e} for s, e in gone])
            kept.append(rest)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
             pa.array(kept, pa.binary())], names=["k1", "k2", "spans", "rest"])


def refined(rows: DataFrame, name: str, *more: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One step of ranks.  ``rows``: row id, first start s and last start e, rank f of what all of their strings hold,
    rank g1 and g2 of what they cover together, and n, how often that is known to occur.

    Gives the rows whose rank f is not unique; those (row id, s, e) of which all starts are repeated; and for each
    distinct string whose starts may or may not be, one row with its number n, together with those to compare it to."""
    # written, so that the join can split a rank that very many rows have
    twice = written(rows.groupBy("f").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("f"), f"twice-{name}")
    again = written(rows.join(twice, "f"), f"again-{name}")
    strings = written(again.groupBy("f", "g1", "g2").agg(F.sum("n").alias("n"), F.min(
        F.struct("k1", "k2", "s", "e", *more)).alias("one")), f"strings-{name}")
    unclear = strings.groupBy("f").agg(F.count(F.lit(1)).alias("strings"), F.min("n").alias("least")).where(
        "strings > 1 and least = 1").select("f")
    whole = again.join(strings.where("n > 1").select("f", "g1", "g2"), ["f", "g1", "g2"]).select("k1", "k2", "s", "e")
    return again, whole, strings.join(unclear, "f").select("one.*", "n")


def repeated_spans(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of ``docs``: key, n_bytes, ``spans`` (the maximal runs of removed bytes; null for none), and
    ``rest`` (the bytes beside them; null where nothing is removed)."""
    t = text_or_empty(text)
    id_type = "k1 long, k2 long"
    known = docs.select(F.col(key).alias("key"), *row_id(key, t), t.alias("text"))
    facts = written(known.select("k1", "k2", "text").mapInArrow(
        _ranked(length), f"{id_type}, n_bytes long, runs array<struct<s:long,e:long,a:long,f:long,g1:long,g2:long>>"), "runs")
    every = facts.select("k1", "k2", F.inline("runs")).withColumn("n", F.lit(1).cast("long"))
    again, whole, unclear = refined(every, "runs", "a")
    texts = written(known.drop("key").join(again.select("k1", "k2").distinct(), ["k1", "k2"]).dropDuplicates(["k1", "k2"]),
                    "texts")  # repeated rows once, as the join has dealt them

    def asked(rows: DataFrame) -> DataFrame:
        listed = rows.groupBy("k1", "k2").agg(F.collect_list(F.struct(
            *[c for c in rows.columns if c not in ("k1", "k2")])).alias("wanted"))  # bounded by the document's length
        return texts.join(listed, ["k1", "k2"]).select("k1", "k2", "text", "wanted")

    cut_up = asked(unclear).mapInArrow(_blocks(length, min(BLOCK, window_of(length))),
                                       f"{id_type}, s long, e long, n long, f long, g1 long, g2 long")
    _, more, unclear = refined(written(cut_up, "blocks"), "blocks")
    starts = written(asked(unclear).mapInArrow(_spelt(length), f"{id_type}, s long, n long, h1 long, h2 long"), "starts")
    twice = starts.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h1", "h2")
    single = starts.where("n = 1").join(twice, ["h1", "h2"]).select("k1", "k2", "s", F.col("s").alias("e"))
    whole = whole.unionByName(more).unionByName(single).withColumn("e", F.col("e") + length)
    spans = whole.distinct().groupBy("k1", "k2").agg(
        F.collect_list(F.struct("s", "e")).alias("spans"))  # bounded by the document's length
    cut = texts.join(spans, ["k1", "k2"]).mapInArrow(
        _cut, f"{id_type}, spans array<struct<start:long,end:long>>, rest binary")
    return docs.select(F.col(key).alias(key), *row_id(key, t), F.octet_length(t).cast("long").alias("n_bytes"),
                       F.sha2(t.cast("binary"), 256).alias("sha256")).join(cut, ["k1", "k2"], "left").drop("k1", "k2")


def q_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_spans(read(spark, sf_dir, "documents").select("doc_id", "text"))
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", F.coalesce(total, F.lit(0)).alias("n_removed"),
                      F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"),
                      F.coalesce(F.sha2("rest", 256), "sha256").alias("kept_sha256"))


QUERIES = {"op2_suffix_dedup": q_suffix_dedup}
ORACLE: dict[str, str] = {}
