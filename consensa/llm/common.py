"""Helpers shared by the training-data operators: reading tables, writing intermediate
tables to the cluster's shared folder, and hashing the words of Arrow text columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from consensa.session import SHUFFLE_CLEANUP, freed, written  # noqa: F401

SHINGLE = 5
#: Bytes of text that a Python worker turns into numpy arrays at once (a longer text makes a chunk of its own).
CHUNK_BYTES = 2_000_000
#: Bits of the map by which ``narrowed`` leaves rows out, 64 in a row of it.
MAP_BITS = 1 << 24
#: Characters between words, as a character class body for Java's, RE2's and Python's regex engines.
BLANKS = r"\x20\x09-\x0D"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def row_key(name: str = "text") -> Column:
    """With the document's id it identifies a row by content.  Rows that agree in both are repeats
    of one another and get the same result, so they need no further key."""
    return F.xxhash64(text_or_empty(name))


def narrowed(rows: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` without most of those whose ``by`` is not in ``wanted``, which is not null there, so that a join of the two
    shuffles little more than it gives.  Only a map of bounded size is broadcast: a bit for each hash of the wanted."""
    at = F.pmod(F.xxhash64(*by), F.lit(MAP_BITS))
    row, bit = F.shiftright("__at", 6).alias("__row"), F.col("__at").bitwiseAND(F.lit(63)).cast("int")
    maps = wanted.select(at.alias("__at")).select(row, F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("__map")).groupBy(
        "__row").agg(F.bit_or("__map").alias("__map"))
    is_set = F.call_function("shiftright", F.col("__map"), bit).bitwiseAND(F.lit(1)) == 1
    return rows.withColumn("__at", at).withColumn("__row", row).join(F.broadcast(maps), "__row").where(is_set).select(
        *[F.col(f"`{c}`") for c in rows.columns])


def chunks(lengths: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose lengths sum to about ``most``; a single longer row is a range of its own."""
    start, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    a = pc.fill_null(a.cast(pa.large_string()), "")
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    _, offs, data = a.buffers()
    offsets = np.frombuffer(offs, np.int64)[a.offset:a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf, offsets


_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20_240_501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


class Words:
    """Words of a run of texts, all in flat arrays: ``start``/``end`` (byte offsets from the first
    text's start), ``hash`` (64 bits, A-Z lower-cased), ``doc`` (number of the text) and ``first``
    (for each text the index of its first word, one more at the end)."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, lower: bool = True):
        lo, hi = int(offsets[0]), int(offsets[-1])
        b = buf[lo:hi]
        off = offsets - lo
        n = len(b)
        word = np.empty(n + 1, bool)
        word[:n] = ~_IS_BLANK[b]
        word[n] = False
        fresh = np.empty(n + 1, bool)  # a word starts here if this byte is in one
        fresh[0] = True
        np.logical_not(word[:n], out=fresh[1:])
        fresh[off] = True
        self.start = np.flatnonzero(word & fresh)
        over = np.empty(n + 1, bool)  # a word that holds this byte ends after it
        over[:n] = fresh[1:] | ~word[1:]
        over[n] = False
        self.end = np.flatnonzero(word & over) + 1
        low = _LOWER[b] if lower else b
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[low] * powers(_BASE, n), out=total[1:])
        h = (total[self.end] - total[self.start]) * powers(_BASE_INVERSE, n + 1)[self.start]
        self.hash = mix(h + (self.end - self.start).astype(np.uint64))
        self.first = np.searchsorted(self.start, off).astype(np.int64)
        self.first[-1] = len(self.start)
        self.doc = np.repeat(np.arange(len(off) - 1), np.diff(self.first))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every run of ``size`` words that begins in a text, and whether it stays in it."""
        m = len(self.hash)
        if m < size:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        out = np.zeros(m - size + 1, np.uint64)
        for k in range(size):
            out += self.hash[k:m - size + 1 + k] * np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64))
        return mix(out), self.doc[:m - size + 1] == self.doc[size - 1:]


def sequence_hash(hashes: np.ndarray) -> np.uint64:
    """Hash of one whole word sequence shorter than a shingle."""
    with np.errstate(over="ignore"):
        total = np.uint64(0xA5A5A5A5A5A5A5A5) * np.uint64(len(hashes))
        for k, h in enumerate(hashes):
            total += h * np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64))
        return mix(np.array([total], np.uint64))[0]
