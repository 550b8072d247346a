"""Phrase matching with Aho-Corasick automata.

The phrases are cut into slices of at most SLICE; a slice is broadcast once and every task makes one automaton of it, which
reads each text once whatever the number of phrases.  The plan holds no phrase, and phrases of any number are matched in as
many passes as there are slices.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Phrases in one automaton: it takes about a hundred bytes for every character that no other phrase begins with.
SLICE = 250_000


def _slices(phrases: DataFrame | list[str]) -> Iterator[list[str]]:
    """The distinct phrases, in order, some at a time; the driver never holds more than one slice."""
    if isinstance(phrases, DataFrame):
        p = phrases.select(F.col(phrases.columns[0]).cast("string").alias("p"))
        each = (r["p"] for r in p.where("p is not null and p <> ''").distinct().orderBy("p").toLocalIterator())
    else:
        each = iter(sorted({p for p in phrases if p}))
    held: list[str] = []
    for p in each:
        held.append(p)
        if len(held) == SLICE:
            yield held
            held = []
    if held:
        yield held


def phrase_matches(df: DataFrame, text: Column, phrases: DataFrame | list[str], out_col: str = "pattern") -> DataFrame:
    """The rows of ``df``, once for every distinct phrase (a list, or the first column of a table) that occurs in ``text``, with
    the phrase as ``out_col``.  Null texts and empty phrases match nothing."""
    names = [c for c in df.columns if c != out_col]
    schema = T.StructType([*(df.schema[c] for c in names), T.StructField(out_col, T.StringType())])
    source = df.select(*[F.col(f"`{c}`") for c in names], text.cast("string").alias("__text"))
    sc = df.sparkSession.sparkContext
    found = [source.mapInArrow(_matcher(sc.broadcast(s), names, out_col), schema) for s in _slices(phrases)]
    return reduce(DataFrame.unionAll, found) if found else source.select(*names, F.lit(None).cast("string").alias(out_col)).where("false")


def _matcher(phrases, names: list[str], out_col: str):
    def run(batches: Iterator) -> Iterator:
        import ahocorasick
        import pyarrow as pa

        automaton = ahocorasick.Automaton()
        for p in phrases.value:
            automaton.add_word(p, p)
        automaton.make_automaton()
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column("__text")):
                text = text.as_py()
                if text:
                    hits = sorted({p for _, p in automaton.iter(text)})
                    at += [i] * len(hits)
                    found += hits
            rows = batch.take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), pa.array(found, pa.string())], names=[*names, out_col])
    return run
