"""Whitening of embeddings: an exact centred scatter on Spark, cyclic Jacobi rotations on the driver, projections in the tasks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reedline.llm.common import stored
from reedline.llm.vectors import lengths_of, matrix, unpacked

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Dimensions that the driver takes: it holds a few matrices of so many rows.
MOST_DIMENSIONS = 2048
#: The largest integer entry; vectors with a larger one are left out.
MOST = 1 << 40
_EPS = 2.0**-52


def integers(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(vec_id, length, x): vectors without null or non-finite entries, each entry floor(SCALE * entry) + OFFSET, packed in 8 bytes."""

    def run(batches):
        for batch in batches:
            lists = batch.column("x")
            at, packed, length = [], [], []
            for n in np.unique(lengths_of(lists)):
                if n < 1:
                    continue
                places, values = matrix(lists, int(n))
                x = np.floor(SCALE * values) + OFFSET
                fits = (np.abs(x) <= MOST).all(axis=1)
                at += places[fits].tolist()
                packed += [row.tobytes() for row in x[fits].astype("<i8")]
                length += [int(n)] * int(fits.sum())
            ids = batch.column("vec_id").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(length, pa.int32()), pa.array(packed, pa.binary())], ["vec_id", "length", "x"])

    return vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("x")).mapInArrow(run, "vec_id long, length int, x binary")


def _exact_scatter(y: np.ndarray) -> np.ndarray:
    """y' y of integers, exact, as Python integers: float64 products where every sum stays below 2^53."""
    total = np.zeros((y.shape[1], y.shape[1]), object)
    most = int(np.abs(y).max(initial=0))
    if most >= 1 << 26:
        wide = y.astype(object)
        return total + wide.T @ wide
    step = (1 << 53) // max(1, most * most)
    for a in range(0, len(y), step):
        part = y[a : a + step].astype(np.float64)
        total += (part.T @ part).astype(np.int64).astype(object)
    return total


def _totals(dimensions: int):
    """Of each task: the sums of the entries."""

    def run(batches):
        total = np.zeros(dimensions, object)
        for batch in batches:
            if batch.num_rows:
                total += unpacked(batch.column("x"), "<i8", dimensions).sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(range(dimensions), pa.int32()), pa.array([str(v) for v in total])], ["i", "total"])

    return run


def _scatters(middle: np.ndarray):
    """Of each task: the sums of products of the entries less `middle`, the upper triangle."""
    i, j = np.triu_indices(len(middle))

    def run(batches):
        total = np.zeros((len(middle), len(middle)), object)
        for batch in batches:
            if batch.num_rows:
                total += _exact_scatter(unpacked(batch.column("x"), "<i8", len(middle)) - middle)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([str(v) for v in total[i, j]])], ["i", "j", "total"])

    return run


def jacobi(symmetric: np.ndarray, sweeps: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a positive semidefinite matrix by cyclic Jacobi rotations.

    A rotation takes the largest part of a pair's off-diagonal entry to zero; sweeps over all pairs go on until every one has vanished beside the geometric mean
    of its two diagonal entries, which is what makes small eigenvalues as accurate as large ones. Equal eigenvalues: by place. The largest entry of each vector is positive.
    """
    a, v = np.array(symmetric, np.float64), np.eye(len(symmetric))
    floor = _EPS**2 * max(np.trace(a), 0.0)
    for _ in range(sweeps):
        turned = False
        for p in range(len(a) - 1):
            for q in range(p + 1, len(a)):
                x = a[p, q]
                if abs(x) <= floor or abs(x) <= _EPS * math.sqrt(abs(a[p, p] * a[q, q])):
                    continue
                turned = True
                theta = (a[q, q] - a[p, p]) / (2 * x)
                t = math.copysign(1.0, theta) / (abs(theta) + math.hypot(theta, 1.0))
                c = 1 / math.hypot(t, 1.0)
                turn = np.array([[c, t * c], [-t * c, c]])
                pair = [p, q]
                low, high = a[p, p] - t * x, a[q, q] + t * x
                a[:, pair] = a[:, pair] @ turn
                a[pair, :] = turn.T @ a[pair, :]
                a[p, p], a[q, q] = low, high
                a[p, q] = a[q, p] = 0.0
                v[:, pair] = v[:, pair] @ turn
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    v = v[:, order]
    signs = np.where(v[np.abs(v).argmax(axis=0), np.arange(len(v))] < 0, -1.0, 1.0) if len(v) else np.ones(0)
    return np.diag(a)[order], v * signs


def _projections(middle: np.ndarray, rest: np.ndarray, matrix_: np.ndarray):
    """Of a packed batch: its entries less the mean (middle + rest), times the whitening matrix."""

    def project(column: pa.Array) -> np.ndarray:
        return ((unpacked(column, "<i8", len(middle)) - middle) - rest) @ matrix_

    return project


def _moments(project, m: int):
    """Of each task: sums of the projections (j = -1) and of their products, of the fit list."""

    def run(batches):
        total = np.zeros((m, m + 1))
        for batch in batches:
            if batch.num_rows:
                w = project(batch.column("x"))
                total[:, 0] += w.sum(axis=0)
                total[:, 1:] += w.T @ w
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel() - 1, pa.int32()), pa.array(total.ravel())], ["i", "j", "total"])

    return run


def _deviations(y: np.ndarray, n: int, rest: list[int]) -> list[int | None]:
    """Sum of (n y - rest)^2 of each row, exact; None where it doesn't fit 63 bits."""
    bound = n * int(np.abs(y).max(initial=0)) + max(map(abs, rest), default=0)
    if bound * bound * y.shape[1] < 1 << 63:
        return np.square(n * y - np.array(rest, np.int64)).sum(axis=1).tolist()
    wide = n * y.astype(object) - np.array(rest, object)
    return [s if s < 1 << 63 else None for s in (wide * wide).sum(axis=1)]


def fit(spark: SparkSession, rows: DataFrame, dimensions: int, components: int = COMPONENTS) -> dict:
    """The whitening of distinct packed vectors (x): n, sums, middle, rest, eigenvalues, trace, the matrix that whitens, identity_error."""
    n = rows.count()
    sums = rows.mapInArrow(_totals(dimensions), "i int, total string").groupBy("i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    s = [0] * dimensions
    for r in sums.collect():
        s[r.i] = int(r.total)
    middle = [v // n for v in s]
    rest = [v - n * m for v, m in zip(s, middle)]  # what the integer middle leaves of each sum
    around = np.array(middle, np.int64)
    parts = rows.mapInArrow(_scatters(around), "i int, j int, total string").groupBy("i", "j").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    v = np.zeros((dimensions, dimensions))
    for r in parts.collect():  # a row an entry of the triangle
        v[r.i, r.j] = v[r.j, r.i] = (n * int(r.total) - rest[r.i] * rest[r.j]) / (n * n)  # exact until this division
    values, vectors = jacobi(v)
    m = min(components, dimensions)
    trace = float(np.trace(v))
    e = values[:m]
    real = e > dimensions * _EPS * trace  # beyond what rounding leaves of nothing
    scale = np.divide(1.0, np.sqrt(np.where(real, e, 1.0)), out=np.zeros(m), where=real)
    whitener = vectors[:, :m] * scale
    off = np.array(rest) / n
    project = _projections(around, off, whitener)
    moments = rows.mapInArrow(_moments(project, m), "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect()
    table = np.zeros((m, m + 1))
    for r in moments:
        table[r.i, r.j + 1] = r.total / n
    covariance = table[:, 1:] - np.outer(table[:, 0], table[:, 0])
    error = float(np.abs((covariance - np.eye(m))[np.ix_(real, real)]).max()) if real.any() else None
    return {"n": n, "sums": s, "middle": around, "rest": rest, "values": values, "trace": trace, "real": real, "whitener": whitener, "identity_error": error}


def whiten(spark: SparkSession, vectors: DataFrame, components: int = COMPONENTS, dimensions: int | None = None, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Each vector's whitened components: vec_id, component (from 1, by falling eigenvalue), n, deviation, whitened, explained, identity_error.

    Entries become integers (see integers). The model is fitted on every distinct vector once; covariances have the divisor n. deviation is the sum over
    dimensions of (n x - S)^2, S the sums, null where it doesn't fit a long; explained is an eigenvalue's share of the trace; identity_error is the largest entry of the
    whitened fit list's covariance less the identity, measured in a pass of its own.

    The scatter is summed in exact integers around the integer middle of each dimension, a matrix a task, so neither one value nor copies make a large task.
    The driver takes dimensions (dimensions + 1) / 2 sums, at most MOST_DIMENSIONS dimensions. Vectors that are null, empty, hold null or non-finite
    entries or one beyond MOST are left out; so are those of other than `dimensions` entries (None: the most frequent length, ties: the longest). A component without variance
    has null as whitened, and without any variance explained and identity_error are null too. Repeated rows, and rows without id, have rows of their own. An empty table: no rows.
    """
    every = stored(spark, integers(vectors, key, column), "entries")
    if dimensions is None:
        most = every.groupBy("length").count().orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
        dimensions = most[0].length if most else 1
    if dimensions > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {dimensions} entries; at most {MOST_DIMENSIONS}")
    rows = every.where(F.col("length") == dimensions)
    distinct = stored(spark, rows.select("x").distinct(), "fit")
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if distinct.isEmpty():
        return spark.createDataFrame([], schema)
    model = fit(spark, distinct, dimensions, components)
    n, rest, real, m = model["n"], model["rest"], model["real"], len(model["real"])
    project = _projections(model["middle"], np.array(rest) / n, model["whitener"])
    explained = [float(e / model["trace"]) if model["trace"] > 0 else None for e in model["values"][:m]]
    error, middle = model["identity_error"], model["middle"]

    def run(batches):
        for batch in batches:
            count = batch.num_rows
            if not count:
                continue
            w = project(batch.column("x")).ravel()
            deviation = _deviations(unpacked(batch.column("x"), "<i8", len(middle)) - middle, n, rest)
            each = np.repeat(np.arange(count), m)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), count)), pa.array(np.full(count * m, n, np.int64)), pa.array(deviation, pa.int64()).take(pa.array(each)),
                    pa.array(w, mask=~np.tile(real, count)), pa.array(explained * count, pa.float64()), pa.array([error] * (count * m), pa.float64()),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.select("vec_id", "x").mapInArrow(run, schema)
