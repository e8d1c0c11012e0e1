"""Connected components of an edge table: forests within tasks, joined by least neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reedline.llm.common import stored

#: Edges that a task holds at a time.
CHUNK = 1 << 18


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of some edges as stars: each node but the least of its component, and that least one."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    top = np.arange(len(nodes))
    while len(open_ := np.flatnonzero(top[a] != top[b])):
        a, b = top[a[open_]], top[b[open_]]
        np.minimum.at(top, np.maximum(a, b), np.minimum(a, b))
        while (top[top] != top).any():
            top = top[top]
    moved = top != np.arange(len(nodes))
    return nodes[moved], nodes[top[moved]]


def _forests(batches):
    """Edges (u, v) of a task as stars, CHUNK of them at a time: a node has one row in each chunk, whatever its degree."""

    def star(held):
        u, v = forest(*(np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("u", "v")))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK:
            yield star(held)
            held, rows = [], 0
    if rows:
        yield star(held)


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root) for every node that an edge (u, v) names; root is the least node of its component.

    Each task that reads edges replaces them by stars of their components, so that few steps are left and a hub is no large group. Then each node is linked to the least of its
    smaller neighbours, or to that one's own least neighbour if there is one; repeated, each component becomes a star around its least
    node. A step is one aggregation and one equi-join, and is stored in the shared folder.
    Rows with a null end and loops are ignored. No edges: no rows.
    """
    ends = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    stars = ends.mapInArrow(_forests, "u long, v long")
    while True:
        near = stored(spark, stars.groupBy("u").agg(F.min("v").alias("m"), F.collect_set("v").alias("others")), "stars")  # others: at most one a chunk
        tops = near.select(F.col("u").alias("v"), F.col("m").alias("top"))
        if near.where(F.size("others") > 1).isEmpty() and near.join(tops, near["m"] == tops["v"], "left_semi").isEmpty():  # stars, all of them
            break
        below = near.select("u", F.explode("others").alias("v")).mapInArrow(_forests, "u long, v long")
        stars = below.join(tops, "v", "left").select("u", F.coalesce("top", "v").alias("v"))
    roots = near.select("m").distinct().select(F.col("m").alias("node"), F.col("m").alias("root"))
    return near.select(F.col("u").alias("node"), F.col("m").alias("root")).unionByName(roots)
