"""Clusters of vectors around integer centroids: float32 products with error bounds choose the candidates, exact integers decide."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reedline.llm.common import stored
from reedline.llm.vectors import matrix, unpacked

DIMENSIONS = 64
CLUSTERS = 8
ROUNDS = 10
SCALE = 1024
#: What the hash that orders the first centroids puts before an id.
SALT = "3:"
#: Components of all centroids together: they go to every task, and their sums to the driver.
MOST_CELLS = 1 << 22
#: Products that one task holds at once.
BLOCK_CELLS = 1 << 22


def limit_of(dimensions: int) -> int:
    """The largest integer component with which every squared distance fits 63 bits."""
    return 1 << ((60 - (dimensions - 1).bit_length()) // 2)


def integers(vectors: DataFrame, key: str, column: str, dimensions: int, scale: int) -> DataFrame:
    """(vec_id, x): vectors of that length without null or non-finite components, each component floor(scale * component), packed in 4 bytes.

    x is null where a component goes beyond limit_of(dimensions).
    """
    most = limit_of(dimensions)

    def run(batches):
        for batch in batches:
            at, values = matrix(batch.column("x"), dimensions)
            x = np.floor(scale * values)
            fits = (np.abs(x) <= most).all(axis=1)
            x = np.where(fits[:, None], x, 0).astype("<i4")
            packed = [row.tobytes() if ok else None for row, ok in zip(x, fits)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at)), pa.array(packed, pa.binary())], ["vec_id", "x"])

    return vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("x")).mapInArrow(run, "vec_id long, x binary")


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each integer vector: the nearest centroid (ties: the smaller number) and its squared distance; and how many pairs exact integers had to decide.

    |x - c|^2 - |x|^2 is |c|^2 - 2 x.c, with x.c as a float32 product. In any order of summation that product is off by at most g * |x| |c|, where g is
    m u / (1 - m u), u = 2^-24 and m the dimensions and 2 for rounding both vectors to float32. A centroid whose interval begins beyond the end of
    another's can't be nearest. Where more than one is left, exact integers decide. All vectors are moved by one integer vector first, the
    centroids' middle, which changes no distance and shortens them.
    """
    n, d = x.shape
    middle = centroids.sum(axis=0) // len(centroids)
    x, c = x.astype(np.int64) - middle, centroids - middle
    c32, c_square = c.astype(np.float32), np.square(c).sum(axis=1)
    up = 1 + 2.0**-40  # more than the float64 rounding of norms and bounds
    g = (d + 2) * 2.0**-24 / (1 - (d + 2) * 2.0**-24)
    c_norm = np.sqrt(np.square(c.astype(np.float64)).sum(axis=1)) * up
    best, distance, decided = np.empty(n, np.int64), np.empty(n, np.int64), 0
    step = max(1, BLOCK_CELLS // max(len(c), d))
    for a in range(0, n, step):
        part = x[a : a + step]
        product = (part.astype(np.float32) @ c32.T).astype(np.float64)
        x_norm = np.sqrt(np.square(part.astype(np.float64)).sum(axis=1)) * up
        score = c_square - 2 * product
        reach = (2 * g * x_norm[:, None] * c_norm + (c_square + 2 * np.abs(product)) * 2.0**-50) * up
        left = score - reach <= (score + reach).min(axis=1, keepdims=True)
        mine = left.argmax(axis=1)
        open_ = np.flatnonzero(left.sum(axis=1) > 1)
        if len(open_):
            row, k = np.nonzero(left[open_])  # ascending numbers in each row
            exact = np.concatenate([np.square(part[open_[row[i : i + step]]] - c[k[i : i + step]]).sum(axis=1) for i in range(0, len(row), step)])
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            least = np.repeat(np.minimum.reduceat(exact, first), np.diff(np.append(first, len(row))))
            hit = np.flatnonzero(exact == least)
            mine[open_] = k[hit[np.unique(row[hit], return_index=True)[1]]]
            decided += len(row)
        best[a : a + step] = mine
        distance[a : a + step] = np.square(part - c[mine]).sum(axis=1)
    return best, distance, decided


def _sums(centroids: np.ndarray):
    """Of each task: per cluster the number of vectors (dim -1) and the sum of each component."""

    def run(batches):
        k, d = centroids.shape
        total = np.zeros((k, d + 1), np.int64)
        for batch in batches:
            x = unpacked(batch.column("x"), "<i4", d)
            best, _, _ = nearest(x, centroids)
            order = np.argsort(best, kind="stable")
            found, first = np.unique(best[order], return_index=True)
            if len(found):
                total[found, 1:] += np.add.reduceat(x[order].astype(np.int64), first, axis=0)
                total[found, 0] += np.diff(np.append(first, len(order)))
        cluster, dim = np.nonzero(total[:, :1] + np.zeros((1, d + 1), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(cluster.astype(np.int32)), pa.array((dim - 1).astype(np.int32)), pa.array(total[cluster, dim])], ["cluster", "dim", "total"])

    return run


def _places(centroids: np.ndarray):
    def run(batches):
        for batch in batches:
            best, distance, _ = nearest(unpacked(batch.column("x"), "<i4", centroids.shape[1]), centroids)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(best.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return run


def cluster(
    spark: SparkSession, vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE,
    salt: str = SALT, key: str = "vec_id", column: str = "embedding",
) -> tuple[DataFrame, DataFrame]:
    """(members, centroids). members: vec_id, cluster, distance (squared). centroids: cluster, components, rows, inertia (distance summed over the cluster).

    Vectors with other than `dimensions` components, or with null or non-finite ones, are left out; a component becomes floor(scale * component).
    The first centroids are the vectors with the least sha256 of salt and id (equal ids: by components; no id: last). In each round every vector goes to its
    nearest centroid, ties to the smaller number, and each centroid with vectors becomes the floor of their mean; then vectors are assigned
    once more. Rounds end early where no centroid has moved, since none would after. Everything is exact, so it doesn't depend on how rows are dealt.

    Each round is one pass over the stored vectors; a task sends one sum a cluster and component, so a cluster with most of the rows is no
    larger task than others. Fewer vectors than clusters: as many clusters as vectors. An empty table: no rows. Repeated rows, and rows without id, are vectors like
    others. A vector with a component too large for distances of 63 bits (see limit_of) belongs to no cluster: its cluster and distance are null.
    Other columns aren't read.
    """
    if clusters < 1 or dimensions < 1 or clusters * dimensions > MOST_CELLS:
        raise ValueError(f"clusters and dimensions must be 1 or more, their product at most {MOST_CELLS}")
    every = stored(spark, integers(vectors, key, column, dimensions, scale), "vectors")
    rows = every.where("x is not null")
    order = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.select(order.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(clusters).collect()
    if not first:
        return every.select("vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")), _table(spark, [])
    now = np.array([np.frombuffer(r.x, "<i4") for r in first], np.int64)
    for _ in range(rounds):
        part = rows.select("x").mapInArrow(_sums(now), "cluster int, dim int, total long")
        sums = part.groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # a row a component
        count = {r.cluster: int(r.total) for r in sums if r.dim < 0}
        then = now.copy()
        for r in sums:
            if r.dim >= 0:
                then[r.cluster, r.dim] = int(r.total) // count[r.cluster]
        if (then == now).all():
            break
        now = then
    members = stored(spark, rows.mapInArrow(_places(now), "vec_id long, cluster int, distance long"), "members")
    found = members.groupBy("cluster").agg(F.count("*").alias("rows"), F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()
    held = {r.cluster: r for r in found}
    table = [(k, [int(v) for v in row], held[k].rows if k in held else 0, held[k].inertia if k in held else Decimal(0)) for k, row in enumerate(now)]
    outside = every.where("x is null").select("vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance"))
    return members.unionByName(outside), _table(spark, table)


def _table(spark: SparkSession, rows: list) -> DataFrame:
    return spark.createDataFrame(rows, "cluster int, components array<long>, rows long, inertia decimal(38,0)")


def digested(members: DataFrame, centroids: DataFrame) -> DataFrame:
    """members with cluster_inertia, inertia (longs, null where they don't fit one) and centroid_sha256 of the final components joined by commas."""
    whole = centroids.agg(F.sum("inertia")).first()[0]
    facts = centroids.select(
        "cluster", F.expr("try_cast(inertia as long)").alias("cluster_inertia"), F.sha2(F.array_join(F.col("components").cast("array<string>"), ",").cast("binary"), 256).alias("centroid_sha256")
    )
    total = F.lit(int(whole) if whole is not None and whole < 1 << 63 else None).cast("long")
    return members.join(F.broadcast(facts), "cluster", "left").select(  # a row a cluster, at most MOST_CELLS components in all
        "vec_id", "cluster", "distance", "cluster_inertia", F.when(F.col("cluster").isNotNull(), total).alias("inertia"), "centroid_sha256"
    )
