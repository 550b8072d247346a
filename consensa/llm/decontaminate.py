"""Benchmark decontamination: SimHash of item-sized windows, then exact weighted-shingle similarity.

Every run of as many words as a benchmark item has is a window; a document with fewer words is one window,
whole.  Its SimHash (BITS bits, each shingle weighted by how often it occurs) is looked up in a multi-index of
the items of that size: fingerprints within RADIUS bits agree in at least one of BLOCKS blocks to within RADIUS //
BLOCKS bits, so each block has a table from its values to items, and a window takes the items of all near values of
any block.  Only for those is the whole distance taken; an item within RADIUS bits is a candidate, which counts
if its weighted Jaccard similarity on five-word shingles (sum of minima over sum of maxima of counts) is at
least SIMILARITY.  Windows that cannot reach that similarity because too few of their shingles occur in
any item at all are left out beforehand, which loses nothing.  The angle between windows as similar as
that puts their fingerprints 19 of 128 bits apart on average with a spread of 4, so RADIUS lies five
spreads above.

Items go to the workers by broadcast in slices of at most SLICE_ITEMS items and SLICE_CHARS characters,
whatever the size of the benchmark; the documents are passed over once for each slice, and written in between, so
that a task holds one slice at a time.

Defined cases: null and empty texts match nothing; items without words match nothing, items shorter than a
shingle match where their words stand in a row; items that are equal are reported each for itself;
repeated rows get equal results; an empty benchmark marks nothing, an empty table gives an empty result;
other columns are kept (the results' own names are replaced).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from consensa.llm.common import SHINGLE, Words, chunks, mix, read, text_buffers, text_or_empty, written

SIMILARITY = 0.8
BITS, BLOCKS, RADIUS = 128, 8, 40
SLICE_ITEMS, SLICE_CHARS = 20_000, 4_000_000
#: Word positions whose bit counts are held at once.
SEGMENT = 20_000
#: By the pigeonhole principle fingerprints within RADIUS are this near in at least one block.
NEAR_BITS = RADIUS // BLOCKS
NEIGHBOURS = np.flatnonzero(np.bitwise_count(np.arange(1 << 16)) <= NEAR_BITS).astype(np.uint16)


def bits_of(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of BITS bits of each shingle."""
    both = np.stack([mix(shingles), mix(shingles ^ np.uint64(0x5851F42D4C957F2D))], 1)
    return np.unpackbits(both.view(np.uint8), axis=1).astype(np.int32) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """BLOCKS numbers of 16 bits from the signs of each row of sums."""
    return np.ascontiguousarray(np.packbits(sums > 0, axis=1)).view(np.uint16)


class BlockTable:
    """Items by the 16 bits of one block of their fingerprints."""

    def __init__(self, blocks: np.ndarray):
        self.values, self.value_of = np.unique(blocks, return_inverse=True)

    def near(self, wanted: np.ndarray) -> np.ndarray:
        """For each value wanted, which items have this block within NEAR_BITS of it: its whole neighbourhood is looked up,
        or the table's own values are gone through where they are fewer."""
        if len(self.values) <= len(NEIGHBOURS):
            close = np.bitwise_count(self.values ^ wanted[:, None]) <= NEAR_BITS
        else:
            close = np.zeros((len(wanted), len(self.values)), bool)
            for k, value in enumerate(wanted):
                around = NEIGHBOURS ^ value
                at = np.minimum(np.searchsorted(self.values, around), len(self.values) - 1)
                close[k, at[self.values[at] == around]] = True
        return close[:, self.value_of]


class Items:
    """The benchmark items of one size: word count, shingle counts, fingerprints and their multi-index."""

    def __init__(self, words: int):
        self.words, self.shingle = words, min(words, SHINGLE)
        self.count = words - self.shingle + 1
        self.ids: list = []
        self.counts: list[dict] = []
        self.rows: list[np.ndarray] = []

    def add(self, item_id, shingles: np.ndarray) -> None:
        values, counts = np.unique(shingles, return_counts=True)
        self.ids.append(item_id)
        self.counts.append(dict(zip(values.tolist(), counts.tolist(), strict=True)))
        self.rows.append(fingerprints(bits_of(shingles).sum(0)[None])[0])

    def index(self) -> None:
        self.prints = np.stack(self.rows)
        self.halves = self.prints.view(np.uint64)
        self.tables = [BlockTable(self.prints[:, k]) for k in range(BLOCKS)]

    def looked_up(self, prints: np.ndarray) -> np.ndarray:
        """For each fingerprint, the items that agree with it in some block to within NEAR_BITS: all within RADIUS, and others."""
        found = self.tables[0].near(prints[:, 0])
        for k in range(1, BLOCKS):
            found |= self.tables[k].near(prints[:, k])
        return found

    def near(self, prints: np.ndarray) -> Iterator[tuple[int, int]]:
        """(window, item) within RADIUS: the whole distance is taken for the items looked up."""
        for at in range(0, len(prints), 256):
            part = prints[at:at + 256]
            w, i = np.nonzero(self.looked_up(part))
            apart = np.bitwise_count(part.view(np.uint64)[w] ^ self.halves[i]).sum(1, dtype=np.int32)
            for k in np.flatnonzero(apart <= RADIUS).tolist():
                yield at + int(w[k]), int(i[k])


class Benchmark:
    def __init__(self, items: list[tuple[object, str]]):
        self.sizes: dict[int, Items] = {}
        known: dict[int, list[np.ndarray]] = {}
        for item_id, text in items:
            data = np.frombuffer(text.encode(), np.uint8)
            w = Words(data, np.array([0, len(data)]))
            if len(w.hash):
                own = self.sizes.setdefault(len(w.hash), Items(len(w.hash)))
                shingles = w.windows(own.shingle)[0]
                own.add(item_id, shingles)
                known.setdefault(own.shingle, []).append(shingles)
        for own in self.sizes.values():
            own.index()
        self.known = {k: np.unique(np.concatenate(v)) for k, v in known.items()}
        self.maybe = {}  # a first look-up by 20 bits
        for k, v in self.known.items():
            self.maybe[k] = np.zeros(1 << 20, bool)
            self.maybe[k][v & np.uint64((1 << 20) - 1)] = True

    def matches(self, w: Words) -> Iterator[tuple[int, object, int, int, float]]:
        """(document, item, first word, words, similarity) for every window that matches."""
        for shingle, known in self.known.items():
            hashes, inside = w.windows(shingle)
            if not len(hashes):
                continue
            hit = np.zeros(len(hashes), bool)
            at = np.flatnonzero(self.maybe[shingle][hashes & np.uint64((1 << 20) - 1)] & inside)
            at = at[known[np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)] == hashes[at]]
            hit[at] = True
            per_doc = np.bincount(w.doc[at], minlength=len(w.first) - 1)
            for doc in np.flatnonzero(per_doc):
                lo, hi = int(w.first[doc]), int(w.first[doc + 1])
                own, total = hashes[lo:hi - shingle + 1], np.zeros(hi - lo - shingle + 2, np.int64)
                np.cumsum(hit[lo:hi - shingle + 1], out=total[1:])
                for items in self.sizes.values():
                    # similarity s needs at least s of a window's shingles to be in the item
                    if items.shingle != shingle or total[-1] < SIMILARITY * items.count - 1e-9:
                        continue
                    count = min(items.count, len(own))  # a document shorter than the item is one window
                    shared = total[count:] - total[:-count]
                    starts = np.flatnonzero(shared >= SIMILARITY * items.count - 1e-9)
                    yield from ((int(doc), *m) for m in self.verified(items, own, starts, count))

    def verified(self, items: Items, hashes: np.ndarray, starts: np.ndarray, count: int):
        """Matches of the windows of ``count`` shingles that begin at ``starts``."""
        while len(starts):
            now = starts[starts < starts[0] + SEGMENT]
            starts = starts[len(now):]
            first = int(now[0])
            bits = np.zeros((int(now[-1]) - first + count + 1, BITS), np.int32)
            np.cumsum(bits_of(hashes[first:first + len(bits) - 1]), axis=0, out=bits[1:])
            prints = fingerprints(bits[now - first + count] - bits[now - first])
            for k, i in items.near(prints):
                s = int(now[k])
                values, counts = np.unique(hashes[s:s + count], return_counts=True)
                other = items.counts[i]
                least = sum(min(c, other.get(v, 0)) for v, c in zip(values.tolist(), counts.tolist(), strict=True))
                similarity = least / (count + items.count - least)
                if similarity >= SIMILARITY:
                    yield items.ids[i], s, count + items.shingle - 1, similarity


def spans(found: list[tuple]) -> list[tuple]:
    """Matches of one document with overlapping windows of an item made one: item, first word, end, similarity."""
    out: list[list] = []
    for item, start, words, similarity in sorted(found, key=lambda m: (str(m[0]), m[1])):
        if out and out[-1][0] == item and start < out[-1][2]:
            out[-1][2], out[-1][3] = start + words, max(out[-1][3], similarity)
        else:
            out.append([item, start, start + words, similarity])
    return [tuple(x) for x in out]


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
         item_text: str = "text") -> DataFrame:
    """``docs`` with ``matches``: item, first word, end (words) and similarity of every passage that is in the benchmark."""
    items = benchmark.select(F.col(item_id).alias("id"), text_or_empty(item_text).alias("text"))
    size = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("c")).first()
    # twice what the bounds ask for, as slices by hash are not even
    slices = 1 if size.n <= SLICE_ITEMS and size.c <= SLICE_CHARS else 2 * max(-(-size.n // SLICE_ITEMS), -(-size.c // SLICE_CHARS))
    id_type = benchmark.schema[item_id].dataType.simpleString()
    kind = f"array<struct<item:{id_type},start:int,end:int,similarity:double>>"
    names = [c for c in docs.columns if c != "matches"]
    out = docs.select(*[F.col(f"`{c}`") for c in names], text_or_empty(text).alias("__text"),
                      F.array().cast(kind).alias("matches"))
    schema = out.schema
    for k in range(slices):
        part = items if slices == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(slices)) == k)
        held = docs.sparkSession.sparkContext.broadcast([(r.id, r.text) for r in part.collect()])  # a bounded slice
        out = out.mapInArrow(_matching(held, len(names)), schema)
        if k + 1 < slices:
            out = written(out, "marked")
    return out.drop("__text")


def _matching(held, text_at: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        bench = Benchmark(held.value)
        for batch in batches:
            buf, off = text_buffers(batch.column(text_at))
            found: dict[int, list] = {}
            for i, j in chunks(np.diff(off)):
                for doc, *match in bench.matches(Words(buf, off[i:j + 1])):
                    found.setdefault(i + doc, []).append(match)
            if found:
                old = batch.column(text_at + 1).to_pylist()
                for i, ms in found.items():
                    old[i] = [*old[i], *(dict(zip(("item", "start", "end", "similarity"), s, strict=True)) for s in spans(ms))]
                column = pa.array(old, batch.schema.field(text_at + 1).type)
                batch = pa.RecordBatch.from_arrays([*batch.columns[:-1], column], schema=batch.schema)
            yield batch
    return run


def q_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mark(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", (F.size("matches") > 0).alias("contaminated"), F.size("matches").alias("n_matches"),
                      F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item"]))).alias("item_ids"))


QUERIES = {"op10_decontaminate": q_decontaminate}
ORACLE: dict[str, str] = {}
