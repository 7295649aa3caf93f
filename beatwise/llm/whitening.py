"""Whitening of embeddings: pivoted Cholesky of the centred scatter, one-sided Jacobi on its triangular factor.

Entries become integers, so counts and sums over all rows are exact and rows are centred without rounding before anything
is multiplied. Tasks add up the products of their rows; only sums of the vectors' width, and its square, reach the driver.
There the covariance V is factored as L L' with diagonal pivoting, and rotations from the right make the columns of L
orthogonal: V = (L Q)(L Q)', so squared column norms are the eigenvalues and normalised columns the components.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: An entry c becomes floor(SCALE * c) + SHIFT; it must be below LARGEST either way, which keeps sums within 64 bits.
SCALE, SHIFT, LARGEST = 64, 1_000_000, 2.0 ** 40
COMPONENTS = 32
EPS = float(np.finfo("float64").eps)
#: A pivot below this many roundings of the largest variance, for each dimension, is no direction of its own.
ROUNDINGS = 16
MOST = 2 ** 62


@dataclass(frozen=True)
class Fit:
    """Of vectors of one length: rows, sums of their entries, eigenvalues, components as columns, trace and the largest
    entry of the whitened rows' covariance less the identity."""
    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    peak: int
    identity_error: float = 0.0


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows and lower triangular L, of as many columns as the rank, with v[order][:, order] = L L'."""
    d = len(v)
    order, low, rest = np.arange(d), np.zeros((d, d)), v.diagonal().copy()
    least = ROUNDINGS * EPS * d * rest.max(initial=0.0)
    for k in range(d):
        p = k + int(np.argmax(rest[k:]))
        if rest[p] <= least:
            return order, low[:, :k]
        for a in (order, low, rest):
            a[[k, p]] = a[[p, k]]
        low[k, k] = np.sqrt(rest[k])
        low[k + 1:, k] = (v[order[k + 1:], order[k]] - low[k + 1:, :k] @ low[k, :k]) / low[k, k]
        rest[k + 1:] -= low[k + 1:, k] ** 2
    return order, low


def rotated(low: np.ndarray, sweeps: int = 100) -> np.ndarray:
    """``low`` times rotations that make its columns orthogonal. A round turns disjoint pairs of columns at once."""
    a, n = low.copy(), low.shape[1]
    ring = np.arange(n + n % 2)
    half = len(ring) // 2
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(ring) - 1):
            p, q = ring[:half], ring[half:][::-1]
            real = (p < n) & (q < n)
            p, q = p[real], q[real]
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            lean = np.abs(xy) / np.sqrt(xx * yy)
            worst = max(worst, lean.max(initial=0.0))
            turn = lean > EPS
            zeta = np.where(turn, yy - xx, 0.0) / np.where(turn, 2 * xy, 1.0)
            t = np.where(turn, np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.hypot(1.0, t)
            a[:, p], a[:, q] = c * x - c * t * y, c * t * x + c * y
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
        if worst <= EPS * max(1, n):
            break
    return a


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a covariance, falling, and unit eigenvectors as columns; as many as its rank. The entry of largest
    size in a vector is positive."""
    order, low = pivoted_cholesky(v)
    columns = np.empty_like(low)
    columns[order] = rotated(low)
    norms = np.sqrt((columns ** 2).sum(0))
    by = np.argsort(-norms, kind="stable")
    columns, norms = columns[:, by] / norms[by], norms[by]
    if columns.size:
        columns *= np.sign(columns[np.abs(columns).argmax(0), np.arange(len(by))])
    return norms ** 2, columns


def remaining(embeddings: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) of the rows whose vector is whole and finite."""
    entry = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    small = lambda c: F.when(F.abs(c) < LARGEST, c).otherwise(F.raise_error(F.lit("an entry has no 64-bit sum at this scale")).cast("double"))
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    # No filter on a filter: a cast array is checked entry by entry, null arrays fall out.
    return vectors.filter(F.forall("vector", entry) & (F.size("vector") > 0)).withColumn("vector", F.transform("vector", small))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """vec_ids and integer entries of the rows of each length in a batch."""
    for batch in batches:
        vectors = batch.column("vector")
        lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
        flat = (np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False)).astype("int64")) + SHIFT
        starts = np.concatenate([[0], np.cumsum(lengths)])
        for d in np.unique(lengths):
            rows = np.flatnonzero(lengths == d)
            yield batch.column("vec_id").take(pa.array(rows)), flat[starts[rows][:, None] + np.arange(d)]


def _sums(rows: DataFrame) -> dict[int, tuple[int, np.ndarray, int]]:
    """By vector length: rows, sums of entries and the largest entry in size; a task adds up its own rows."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, peak = {}, {}, {}
        for _, x in _blocks(batches):
            d = x.shape[1]
            n[d] = n.get(d, 0) + len(x)
            total[d] = total.get(d, 0) + x.sum(0)
            peak[d] = max(peak.get(d, 0), int(np.abs(x).max()))
        for d in n:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, v), pa.int64()) for v in (d, n[d])] + [pa.array(np.arange(d)), pa.array(total[d]), pa.array(np.full(d, peak[d]))],
                                             names=["d", "n", "i", "total", "peak"])

    parts = rows.select("vec_id", "vector").mapInArrow(add, "d long, n long, i long, total long, peak long")
    whole = parts.groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("peak").alias("peak")).toPandas().sort_values(["d", "i"])
    return {int(d): (int(g["n"].iat[0]), g["total"].to_numpy("int64"), int(g["peak"].max())) for d, g in whole.groupby("d")}


def _centred(x: np.ndarray, fit: Fit) -> np.ndarray:
    """n * x - S as integers; Python's own where 64 bits might not hold them."""
    wide = x if 2 * fit.n * fit.peak < MOST else x.astype(object)
    return wide * fit.n - fit.sums


def _products(rows: DataFrame, fits: dict[int, Fit], project: bool) -> dict[int, np.ndarray]:
    """By vector length: the mean product of centred entries, or of whitened ones, over all rows."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {}
        for _, x in _blocks(batches):
            d = x.shape[1]
            y = _whitened(x, fits[d]) if project else (_centred(x, fits[d]) / fits[d].n).astype("float64")
            total[d] = total.get(d, 0.0) + y.T @ y
        for d, g in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), d)), pa.array(np.arange(len(g))), pa.array(list(g), pa.list_(pa.float64()))], names=["d", "i", "row"])

    parts = rows.select("vec_id", "vector").mapInArrow(add, "d long, i long, row array<double>")
    cells = parts.select("d", "i", F.posexplode("row").alias("j", "g")).groupBy("d", "i", "j").agg(F.sum("g").alias("g")).toPandas().sort_values(["d", "i", "j"])
    return {int(d): g["g"].to_numpy().reshape(g["i"].max() + 1, -1) / fits[d].n for d, g in cells.groupby("d")}


def _whitened(x: np.ndarray, fit: Fit) -> np.ndarray:
    return (_centred(x, fit) / fit.n).astype("float64") @ (fit.vectors / np.sqrt(fit.values))


def train(rows: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """The fit of all ``rows`` (of ``remaining``) by vector length. The driver holds one matrix of the length squared.

    Whitened entries have mean 0, since the centred integers add up to 0; their covariance is their mean product.
    """
    fits = {d: Fit(n, s, np.empty(0), np.empty((d, 0)), 0.0, peak) for d, (n, s, peak) in _sums(rows).items()}
    for d, v in _products(rows, fits, False).items():
        values, vectors = eigen((v + v.T) / 2)
        fits[d] = Fit(fits[d].n, fits[d].sums, values[:components], vectors[:, :components], float(v.trace()), fits[d].peak)
    some = {d for d, f in fits.items() if len(f.values)}
    for d, w in _products(rows.filter(F.size("vector").isin(*some)), fits, True).items() if some else ():
        f = fits[d]
        fits[d] = Fit(f.n, f.sums, f.values, f.vectors, f.trace, f.peak, float(np.abs(w - np.eye(len(w))).max()))
    return fits


SCORES = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("component", T.IntegerType(), False), T.StructField("n", T.LongType(), False),
                       T.StructField("deviation", T.DecimalType(38, 0), False), T.StructField("whitened", T.DoubleType(), False),
                       T.StructField("explained", T.DoubleType(), False), T.StructField("identity_error", T.DoubleType(), False)])


def project(rows: DataFrame, fits: dict[int, Fit]) -> DataFrame:
    """A row per row of ``remaining`` and component: see ``whiten``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(batches):
            fit = fits.get(x.shape[1])
            if fit is None or not len(fit.values):
                continue
            k, far = len(fit.values), _centred(x, fit)
            if x.shape[1] * (2 * fit.n * fit.peak) ** 2 >= MOST:
                far = far.astype(object)
            deviation = pa.array([Decimal(int(v)) for v in (far * far).sum(1)], pa.decimal128(38, 0))
            each = pa.array(np.repeat(np.arange(len(x)), k))
            again = lambda a: pa.array(np.tile(a, len(x)))
            yield pa.RecordBatch.from_arrays(
                [ids.take(each), again(np.arange(1, k + 1, dtype="int32")), again(np.full(k, fit.n)), deviation.take(each), pa.array(_whitened(x, fit).ravel()),
                 again(fit.values / fit.trace), again(np.full(k, fit.identity_error))], names=SCORES.names)

    return rows.select("vec_id", "vector").mapInArrow(run, SCORES)


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1, by falling eigenvalue), n, deviation (sum of (n x - S)^2, exact), whitened, explained,
    identity_error: a row per vector and component.

    ``embeddings`` has vec_id and embedding; other columns are ignored. Rows whose vector is null, empty or holds a null
    or non-finite entry are dropped. Rows that repeat count and come out as often as they occur; a null vec_id stays null.
    Vectors of different lengths are fitted apart. A component without variance (constant or dependent dimensions, a
    single row) can't be scaled and has no rows, so there are as many components as the rank, up to ``components``.
    An entry of 2^40 or more in size is an error, since sums of such entries need not fit 64 bits.
    """
    rows = remaining(embeddings)
    return project(rows, train(rows, components))
