"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its factor.

An entry c becomes the integer x = floor(SCALE * c) + SHIFT.  Three passes over the vectors, all in Arrow batches:

* the number n of vectors and the exact sum S of every dimension;
* the scatter, the sum of (x - S/n)(x - S/n)': centred before it is multiplied, with the mean split into an integer and
  a rest below one, so that no digit is lost to the shift; a task gives one row for each dimension, Spark adds them up;
* the projection of every vector, written to the shared folder; its own mean and covariance are measured there.

The scatter (dimensions squared, whatever the number of vectors) is factored on the driver.  Cholesky takes the largest
remaining diagonal entry as the next pivot and ends where that is within rounding of zero, so a singular scatter needs no
care: the factor L has as many columns as the scatter has rank.  Jacobi rotates pairs of columns of L itself until all are
orthogonal (L V = U diag(s)), so that the scatter is U diag(s^2) U': the squared norms over n are the eigenvalues of the
covariance, to high relative precision, and the columns over their norms its unit eigenvectors.

Defined cases: a row is left out if its vector is null, empty, or holds a null, a NaN, an infinity or an entry whose x
is over 2^52 in size (no double holds such an x exactly); if lengths differ, the commonest counts (of equally common
ones the greatest) and rows of another are left out; a null key stays null; repeated rows count each; there are no
components for directions without variance, so none for one vector or for equal vectors, and none for an empty table;
of equal eigenvalues any rotation is right; other columns of the input are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from consensa.llm.common import read, written

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Largest x that is taken.
LARGEST = float(1 << 52)
#: Pivots below this share of the largest diagonal entry are rounding errors.
RANK = 1e-13
#: Two columns count as orthogonal below this cosine.
ORTHOGONAL = 1e-15
SWEEPS = 60
#: Rows of vectors turned into numpy at once.
ROWS = 4096


def vectors_of(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row numbers, lengths, values end to end) of the rows of an Arrow list column whose vectors can be used; the values
    are x, as doubles that hold integers."""
    import pyarrow.compute as pc

    values = pc.cast(column.flatten(), "double")  # leaves out what null rows hold
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)).astype(np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(pc.fill_null(values, float("nan")).to_numpy(zero_copy_only=False) * SCALE) + SHIFT
        good = np.abs(x) <= LARGEST  # false for NaN
    end = np.cumsum(sizes)
    bad = np.concatenate([[0], np.cumsum(~good)])
    use = (sizes > 0) & (bad[end] == bad[end - sizes])
    return np.flatnonzero(use), sizes[use], x[np.repeat(use, sizes)]


def matrices(column, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, x as a matrix) of the usable vectors with ``dims`` dimensions, some thousand rows at a time."""
    for start in range(0, len(column), ROWS):
        rows, sizes, x = vectors_of(column.slice(start, ROWS))
        fits = sizes == dims
        if fits.any():
            yield rows[fits] + start, x[np.repeat(fits, sizes)].reshape(-1, dims)


def _sums(batches: Iterator) -> Iterator:
    """One row for each length of vectors and dimension: vectors and the sum of x, exact."""
    import pyarrow as pa

    total: dict[int, list] = {}
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            rows, sizes, x = vectors_of(batch.column(0).slice(start, ROWS))
            for d in np.unique(sizes).tolist():
                fits = sizes == d
                y = x[np.repeat(fits, sizes)].reshape(-1, d)
                exact = y.sum(0).astype(np.int64) if np.abs(y).max() * len(y) < 2 ** 53 else y.astype(object).sum(0)
                n, s = total.get(d, (0, np.zeros(d, object)))
                total[d] = [n + len(y), s + np.array([int(v) for v in exact], object)]
    for d, (n, s) in total.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()),
             pa.array([str(v) for v in s], pa.string())], names=["dims", "i", "n", "s"])


def _scatter(dims: int, whole: np.ndarray, rest: np.ndarray):
    """Rows i of a task's scatter about the mean ``whole + rest``."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros((dims, dims))
        for batch in batches:
            for _, x in matrices(batch.column(0), dims):
                y = (x - whole) - rest
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))],
                                         names=["i", "row"])
    return run


def pivoted_cholesky(a: np.ndarray, tolerance: float = RANK) -> np.ndarray:
    """L (as many columns as the rank) with L L' = a for a positive semidefinite matrix.  Rows stay in the matrix's order:
    sorted by pivot, L is lower triangular."""
    rest, factor = np.diag(a).copy(), np.zeros_like(a)
    if not len(a) or rest.max() <= 0:
        return factor[:, :0]
    least, left = tolerance * rest.max(), np.ones(len(a), bool)
    for k in range(len(a)):
        p = int(np.argmax(np.where(left, rest, -np.inf)))
        if rest[p] <= least:
            return factor[:, :k]
        left[p] = False
        factor[p, k] = np.sqrt(rest[p])
        factor[left, k] = (a[left, p] - factor[left, :k] @ factor[p, :k]) / factor[p, k]
        rest[left] -= factor[left, k] ** 2
    return factor


def one_sided_jacobi(factor: np.ndarray, orthogonal: float = ORTHOGONAL, sweeps: int = SWEEPS) -> np.ndarray:
    """The factor with its columns rotated until they are orthogonal, by falling norm.  A sweep meets every pair of columns
    once; the pairs of one step are disjoint and rotated together."""
    u = factor.copy()
    m = u.shape[1] + u.shape[1] % 2
    order = np.arange(m)
    for _ in range(sweeps):
        most = 0.0
        for _ in range(m - 1):
            p, q = order[:m // 2], order[m // 2:][::-1]
            real = (p < u.shape[1]) & (q < u.shape[1])
            p, q = p[real], q[real]
            a, b, c = (u[:, p] ** 2).sum(0), (u[:, q] ** 2).sum(0), (u[:, p] * u[:, q]).sum(0)
            cosine = np.abs(c) / np.sqrt(a * b)
            turn = cosine > orthogonal
            most = max(most, cosine.max(initial=0.0))
            zeta = (b - a)[turn] / (2 * c[turn])
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            cos = 1 / np.hypot(1, t)
            x, y = u[:, p[turn]], u[:, q[turn]]
            u[:, p[turn]], u[:, q[turn]] = cos * x - cos * t * y, cos * t * x + cos * y
            order = np.concatenate([order[:1], order[-1:], order[1:-1]])  # round robin about the first
        if most <= orthogonal:
            break
    return u[:, np.argsort(-(u ** 2).sum(0), kind="stable")]


class Whitening:
    """What the vectors of a table are projected with: n, S (``sums``), eigenvalues (falling), components (columns)."""

    def __init__(self, n: int, sums: list[int], scatter: np.ndarray):
        self.n, self.sums, self.dims = n, sums, len(sums)
        self.whole, self.rest = split_mean(n, sums)
        turned = one_sided_jacobi(pivoted_cholesky(scatter))
        norms = np.sqrt((turned ** 2).sum(0))
        self.components, self.eigenvalues = turned / norms, norms ** 2 / max(n, 1)
        self.trace = float(np.trace(scatter)) / max(n, 1)


def split_mean(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The mean as integers and what is left, each the nearest double."""
    whole = [(2 * s + n) // (2 * n) for s in sums]
    return np.array(whole, float), np.array([(s - n * w) / n for s, w in zip(sums, whole, strict=True)])


def fit(df: DataFrame, vector: str = "embedding") -> Whitening | None:
    """The whitening of all usable vectors; None if there are none."""
    column = df.select(F.col(vector).cast("array<double>").alias("v"))
    sums = column.mapInArrow(_sums, "dims int, i int, n long, s string").groupBy("dims", "i").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    common = sums.where("i = 0").orderBy(F.desc("n"), F.desc("dims")).first()
    if common is None:
        return None
    dims, n = common["dims"], common["n"]
    s = [int(r["s"]) for r in sums.where(F.col("dims") == dims).orderBy("i").collect()]  # one number for each dimension
    parts = column.mapInArrow(_scatter(dims, *split_mean(n, s)), "i int, row array<double>").select(
        "i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    scatter = np.zeros((dims, dims))
    for r in parts:
        scatter[r["i"], r["j"]] = r["v"]
    return Whitening(n, s, (scatter + scatter.T) / 2)


def _projected(w: Whitening, most: int):
    """Key, deviation and whitened values (all components at once) of the usable vectors."""
    basis = w.components[:, :most] / np.sqrt(w.eigenvalues[:most])
    sums, top = np.array(w.sums, object), max((abs(s) for s in w.sums), default=0)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for rows, x in matrices(batch.column(1), w.dims):
                far = int(np.abs(x).max()) * w.n + top  # no n * x - S is larger
                near = float(np.abs((x - w.whole) - w.rest).max()) * w.n + 1
                if far < 1 << 62 and w.dims * near * near < 2.0 ** 62:
                    z = x.astype(np.int64) * w.n - sums.astype(np.int64)
                    deviation = [str(v) for v in (z * z).sum(1).tolist()]
                else:
                    deviation = [str(sum((int(v) * w.n - s) ** 2 for v, s in zip(row, sums, strict=True))) for row in x.tolist()]
                white = ((x - w.whole) - w.rest) @ basis
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array(deviation, pa.string()), pa.array(list(white), pa.list_(pa.float64()))],
                    names=["key", "deviation", "white"])
    return run


def whiten(df: DataFrame, most: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for every usable vector and component up to ``most``: the key, component (from 1), n, deviation (exact, null over
    38 digits), whitened, explained and identity_error (the same in all rows)."""
    own = key if key not in ("component", "n", "deviation", "whitened", "explained", "identity_error") else "key"
    key_type = df.schema[key].dataType
    w = fit(df, vector)
    k = 0 if w is None else min(most, len(w.eigenvalues))
    fields = [T.StructField("key", key_type), T.StructField("deviation", T.StringType()),
              T.StructField("white", T.ArrayType(T.DoubleType()))]
    given = df.select(F.col(f"`{key}`").alias("key"), F.col(vector).cast("array<double>").alias("v"))
    white = given.limit(0).select("key", F.lit("").alias("deviation"), "v") if not k else written(
        given.mapInArrow(_projected(w, most), T.StructType(fields)), "whitened")
    white = white.toDF("key", "deviation", "white")
    at = lambda i: F.get("white", F.lit(i))
    error = 0.0
    if k:
        mean = white.agg(*[F.avg(at(i)).alias(f"m{i}") for i in range(k)]).first()
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        cov = white.agg(*[F.avg((at(i) - mean[i]) * (at(j) - mean[j])).alias(f"c{i}_{j}") for i, j in pairs]).first()
        error = max(abs(c - (i == j)) for c, (i, j) in zip(cov, pairs, strict=True))
    explained = [float(e) / w.trace for e in w.eigenvalues[:k]] if k else [0.0]
    return white.select("key", "deviation", F.posexplode("white").alias("at", "whitened")).select(
        F.col("key").alias(own), (F.col("at") + 1).alias("component"), F.lit(w.n if w else 0).cast("long").alias("n"),
        F.col("deviation").try_cast("decimal(38,0)").alias("deviation"), "whitened",
        F.get(F.array(*[F.lit(e) for e in explained]), F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))


def q_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deviation is null where it is beyond a long."""
    out = whiten(read(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))


QUERIES = {"op11_whitening": q_whitening}
ORACLE: dict[str, str] = {}
