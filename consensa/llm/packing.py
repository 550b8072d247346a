"""Concatenate and cut: documents end to end, cut into fixed windows of tokens.

First pass: every task tokenises its documents and notes for each how many of the task's tokens come
before it; the token table goes to the shared folder.  The totals of the tasks (one row each) are summed
up into the global offset at which each task's tokens begin.  Second pass: with that offset every
document is cut where a window ends; a document that crosses an end gives a piece (boundary record) to
each window that it touches.  All windows but the last are full, so there is no padding but at the end.

Defined cases: null text counts as empty and gives its end token alone; repeated rows are packed each
for themselves; a text of many windows gives a piece for each; an empty table gives no pieces; other
columns of the input are left out.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from consensa.llm.common import read, text_or_empty, written

SEQUENCE = 2048
END_ID = 1
#: Words whose ids a worker remembers before it starts over.
CACHED_WORDS = 800_000
#: Up to so many tasks their offsets (16 bytes each) are broadcast; beyond, they are joined by shuffle.
BROADCAST_TASKS = 500_000
#: Bytes of ids in one Arrow batch.
BATCH_BYTES = 8_000_000

_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


class ByteBpe:
    """Ids of a byte-level BPE vocabulary as packed 16-bit integers, native byte order.

    The vocabulary's split pattern never joins characters across a lone space between two words, but puts
    the space in front of the second: so a text's ids are those of its words one after another, each with
    the space before it, and a word's ids can be remembered.  Words new to the worker go through the rank
    file of the same vocabulary; those that may hold a special token go through the tokenizer file itself.
    """

    def __init__(self, tokenizer_file: str, rank_file: str):
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(rank_file, "rb"))}
        ordinary = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                     special_tokens={}).encode_ordinary
        self.full = full = Tokenizer.from_file(tokenizer_file)
        from array import array

        def packed(piece: str) -> bytes:
            if "<|" in piece:
                return array("H", full.encode(piece, add_special_tokens=False).ids).tobytes()
            return array("H", ordinary(piece)).tobytes()

        class Remembered(dict):
            odd = False  # a word came with blanks at its ends: the spaces beside it stand not alone

            def __missing__(self, word: str) -> bytes:
                if not word or word[0].isspace() or word[-1].isspace():
                    self.odd = True
                    return b""
                if len(self) >= CACHED_WORDS:
                    self.clear()
                self[word] = ids = packed(" " + word)
                return ids

        self.packed, self.after_space = packed, Remembered()

    def __call__(self, text: str) -> bytes:
        known = self.after_space
        first, *rest = text.split(" ")
        known.odd = bool(rest) and (not first or first[-1].isspace())
        ids = b"" if known.odd else self.packed(first) + b"".join(map(known.__getitem__, rest))
        if known.odd:
            first, *rest = _LONE_SPACE.split(text)
            ids = self.packed(first) + b"".join([self.packed(" " + w) for w in rest])
        return ids


def byte_bpe(tokenizer_file: str | None = None, rank_file: str | None = None) -> Callable[[], ByteBpe]:
    """Makes the encoder on the worker; the files are found there."""
    def make() -> ByteBpe:
        return ByteBpe(tokenizer_file or public_tokenizers.path("byte_bpe_50k.json"),
                       rank_file or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return make


def tokenized(docs: DataFrame, make_encoder: Callable, end_id: int, key: str, text: str) -> DataFrame:
    """For each document: task number, tokens of the task before it, its tokens (packed)."""
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        task, before, encode, end = TaskContext.get().partitionId(), 0, make_encoder(), np.array([end_id], np.uint16).tobytes()
        for batch in batches:
            held, start, at, size = [], 0, [], 0
            for i in range(batch.num_rows):
                ids = encode(batch.column(1)[i].as_py()) + end
                held.append(ids)
                at.append(before)
                before += len(ids) // 2
                size += len(ids)
                if size > BATCH_BYTES or i + 1 == batch.num_rows:
                    n = len(held)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(start, n), pa.array([task] * n, pa.int32()), pa.array(at, pa.int64()),
                         pa.array([len(x) // 2 for x in held], pa.int64()), pa.array(held, pa.binary())],
                        names=["key", "task", "before", "n", "ids"])
                    held, at, start, size = [], [], i + 1, 0

    return docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text")).mapInArrow(
        run, f"key {key_type}, task int, before long, n long, ids binary")


def pack(docs: DataFrame, make_encoder: Callable | None = None, sequence: int = SEQUENCE, end_id: int = END_ID,
         key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: the document's key, ``start`` (its tokens before the piece), ``length``,
    ``doc_tokens``, ``sequence_id``, ``offset`` in that sequence, and ``ids`` (32-bit little-endian)."""
    tokens = written(tokenized(docs, make_encoder or byte_bpe(), end_id, key, text), "tokens")
    totals = tokens.groupBy("task").agg(F.sum("n").alias("total"))
    begin = totals.select("task", (F.sum("total").over(Window.orderBy("task")) - F.col("total")).alias("begin"))
    begin = F.broadcast(begin) if totals.count() <= BROADCAST_TASKS else begin
    placed = tokens.join(begin, "task").select("key", (F.col("begin") + F.col("before")).alias("at"), "n", "ids")
    key_type = tokens.schema["key"].dataType.simpleString()

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [key, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
        for batch in batches:
            at, n = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            row, start, length, ids, size = [], [], [], [], 0

            def out():
                r, s = np.array(row, np.int64), np.array(start, np.int64)
                whole = np.array(at, np.int64)[r] + s
                return pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(r)), pa.array(s), pa.array(length, pa.int64()),
                     pa.array(np.array(n, np.int64)[r]), pa.array(whole // sequence), pa.array(whole % sequence),
                     pa.array(ids, pa.binary())], names=names)

            for i in range(batch.num_rows):
                packed, done = np.frombuffer(batch.column(3)[i].as_py(), np.uint16), 0
                while done < n[i]:
                    take = min(n[i] - done, sequence - (at[i] + done) % sequence)
                    row.append(i), start.append(done), length.append(take)
                    ids.append(packed[done:done + take].astype("<u4").tobytes())
                    done += take
                    size += 4 * take
                    if size > BATCH_BYTES:
                        yield out()
                        row, start, length, ids, size = [], [], [], [], 0
            if row:
                yield out()

    return placed.mapInArrow(cut, f"`{key}` {key_type}, start long, length long, doc_tokens long, "
                                  "sequence_id long, offset long, ids binary")


def q_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op7_packing": q_packing}
ORACLE: dict[str, str] = {}
