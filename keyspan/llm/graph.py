"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyspan.session import materialize


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node of its component) of the graph that the given edges make."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def shortened(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the same components, at most one per node and task: those of a task are joined inside it."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = v = np.empty(0, np.int64)
        for batch in batches:
            a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            u, v = _forest(np.concatenate([u, a]), np.concatenate([v, b]))
        if len(u):
            yield pa.RecordBatch.from_pydict({"u": u, "v": v})

    return edges.select("u", "v").where("u <> v").mapInArrow(work, "u long, v long")


def few_files(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as at most one file per core: for narrow tables that come out of an exchange."""
    return materialize(df.coalesce(df.sparkSession.sparkContext.defaultParallelism), label)


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, comp): every node of an edge (u, v), u <> v, with the least node of its connected component.

    Rounds of large and small stars: each node links its larger neighbours, then all its smaller ones, to the least
    neighbour, until every node has one edge and it leads to a node without one. The number of rounds grows with the
    logarithm of the component's size, each is written to the shared folder, and no neighbourhood is ever gathered:
    least neighbours are minima made in the tasks first.
    """
    now = few_files(shortened(edges).distinct(), label)
    while True:
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into"))
        ends = ends.unionByName(now.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        ends = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
        if ends.where("out > 1 OR (out > 0 AND into = 1)").isEmpty():
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = few_files(shortened(small.unionByName(least.select("u", F.col("m").alias("v")))).distinct(), label)
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    )
