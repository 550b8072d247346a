"""Truncated SVD of a term matrix kept as rows ``(doc, term, w)``, by randomised block power iteration.

The matrix A is never densified.  A block of ``k + oversample`` vectors over the terms, random at first (by a hash of the
term), is multiplied by A and by A' in turn, each product a join and a sum; then it is made orthonormal.  The Gram matrices
of the two products (block by block numbers) are all that the driver sees: that of the terms' side makes the block
orthonormal, that of the documents' side gives the singular values so far (its eigenvalues are their squares) and, at the end,
the rotation of the block into singular vectors.  The loop ends when no singular value moves by more than ``tol`` (of the first);
vectors are then right to about its root.  A larger ``oversample`` takes fewer rounds.

Defined cases: with fewer documents, terms or independent rows than asked there are as many components as the rank (at
least one); an empty table gives an empty result and no singular values; documents without a row have none here either; the
sign of a component is such that its largest weight by size is positive, the least term deciding ties.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from consensa.operators.vectors import l2_normalize
from consensa.session import cut_lineage

#: Directions with less than this share of the largest one's square are rounding errors.
RANK = 1e-13


@dataclass
class TermSvd:
    """``values`` (falling), ``components(term, v)`` and ``projections(doc, p)``: A = U diag(values) V', ``p`` a row of A V."""
    values: list[float]
    components: DataFrame
    projections: DataFrame


def _gram(df: DataFrame, column: str) -> np.ndarray:
    """Sum over the rows of each row's vector times itself."""
    def partial(batches):
        import pyarrow as pa
        total = None
        for batch in batches:
            x = np.asarray(batch.column(0).flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, -1)
            total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    cells = df.select(column).mapInArrow(partial, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v")).groupBy(
        "i", "j").agg(F.sum("v").alias("v")).collect()  # a row for each pair of block columns
    size = 1 + max((r["i"] for r in cells), default=-1)
    out = np.zeros((size, size))
    for r in cells:
        out[r["i"], r["j"]] = r["v"]
    return (out + out.T) / 2


def _times(df: DataFrame, column: str, matrix: np.ndarray) -> DataFrame:
    """``df`` with its vectors times a small matrix."""
    other = [c for c in df.columns if c != column]

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            x = np.asarray(batch.column(column).flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in other), pa.array(list(x @ matrix), pa.list_(pa.float64()))], names=[*other, column])

    ddl = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in other)
    return df.select(*other, column).mapInArrow(run, f"{ddl}, {column} array<double>")


def _product(a: DataFrame, block: DataFrame, by: str, to: str, size: int) -> DataFrame:
    """A (or A') times a block of ``size`` columns: (``to``, q)."""
    at = lambda j: F.sum(F.col("w") * F.get("q", F.lit(j)))
    summed = a.join(block, by).groupBy(to).agg(*[at(j).alias(f"s{j}") for j in range(size)])
    return cut_lineage(summed.select(to, F.array(*[F.col(f"s{j}") for j in range(size)]).alias("q")))


def _random(term: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda j: F.xxhash64(j, term) / float(1 << 63))


def term_svd(weights: DataFrame, k: int, oversample: int = 24, iterations: int = 60, tol: float = 1e-13) -> TermSvd:
    """The ``k`` largest singular values and vectors (at most one less than there are terms) of ``weights(doc, term, w)``."""
    a = cut_lineage(weights.select("doc", "term", F.col("w").cast("double").alias("w")))
    n_docs, n_terms = a.agg(F.count_distinct("doc"), F.count_distinct("term")).first()
    k = max(1, min(k, n_terms - 1))
    size = min(k + oversample, n_docs, n_terms)
    if not size:
        empty = F.array().cast("array<double>")
        return TermSvd([], a.select("term", empty.alias("v")), a.select("doc", empty.alias("p")))
    block = a.select("term").distinct().select("term", _random(F.col("term"), size).alias("q"))
    before, asked = None, size
    for step in range(iterations + 1):
        # orthonormal, without the directions that have no length
        e, u = np.linalg.eigh(_gram(block, "q"))
        keep = e > RANK * e.max()
        size = int(keep.sum())
        block = cut_lineage(_times(block, "q", u[:, keep] / np.sqrt(e[keep])))
        docs = _product(a, block, "term", "doc", size)
        e, u = np.linalg.eigh(_gram(docs, "q"))
        e, u = np.maximum(e[::-1], 0), u[:, ::-1]
        values = np.sqrt(e[:k])
        whole = step and (size < asked or size == min(n_docs, n_terms))  # the block holds every direction there is
        if whole or step == iterations or before is not None and len(before) == len(values) and np.abs(values - before).max() <= tol * values[0]:
            break
        before = values
        block = _product(a, docs, "doc", "term", size)
    k = max(1, int((e[:k] > RANK * e[0]).sum()))
    components = cut_lineage(_times(block, "q", u[:, :k]).select("term", F.col("q").alias("v")))
    largest = components.select("term", F.posexplode("v").alias("j", "x")).groupBy("j").agg(
        F.min(F.struct((-F.round(F.abs("x"), 9)).alias("size"), "term", "x")).alias("m")).select("j", F.col("m.x").alias("x")).collect()
    sign = np.ones(k)
    for r in largest:  # a row for each component
        sign[r["j"]] = -1.0 if r["x"] < 0 else 1.0
    flip = np.diag(sign)
    return TermSvd(np.sqrt(e[:k]).tolist(), _times(components, "v", flip), _times(docs, "q", u[:, :k] @ flip).select("doc", F.col("q").alias("p")))


def reduce_term_dims(weights: DataFrame, k: int, **how) -> DataFrame:
    """``(doc, reduced)``: the rows of ``weights(doc, term, w)`` projected on ``max(1, min(k, terms - 1))`` right singular vectors
    and L2-normalised."""
    return term_svd(weights, k, **how).projections.select("doc", l2_normalize(F.col("p")).alias("reduced"))
