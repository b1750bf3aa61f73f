"""Connected components of an undirected edge list: forests within tasks, then alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.llm._common import stash

#: Edges of which a task makes one forest.
FOREST_EDGES = 1 << 20


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place that each of n places can reach over the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _forests(edges: DataFrame) -> DataFrame:
    """Edges that connect the same nodes: of those that a task reads, each node's to the least one that it can reach by them, for so many
    edges at a time. Nothing is shuffled, and a task holds a bounded number of edges."""

    def stars(blocks: list[pa.RecordBatch]) -> pa.RecordBatch:
        u, v = (np.concatenate([np.asarray(b.column(i), dtype=np.int64) for b in blocks]) for i in (0, 1))
        names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        label = forest(len(names), at[: len(u)], at[len(u) :])
        linked = np.flatnonzero(label != np.arange(len(names)))
        return pa.RecordBatch.from_arrays([pa.array(names[linked]), pa.array(names[label[linked]])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for start in range(0, batch.num_rows, FOREST_EDGES):
                held.append(batch.slice(start, FOREST_EDGES))
                if sum(b.num_rows for b in held) >= FOREST_EDGES:
                    yield stars(held)
                    held = []
        if held:
            yield stars(held)

    return edges.mapInArrow(run, "u long, v long")


def _least(sides: DataFrame) -> DataFrame:
    """Each directed edge (u, v) with ``low``, the least of u and its neighbours. Least values come from an aggregate that is combined
    before the shuffle, and the join on a node can be split when the node is hot."""
    least = sides.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low"))
    return sides.join(least, sides["u"] == least["node"]).select("u", "v", F.least("u", "low").alias("low"))


def _contracted(edges: DataFrame) -> DataFrame:
    """Both contraction steps on edges (u, v) with u > v.

    Large star: every neighbour of a node that is greater than the node is linked to the least of its neighbourhood. Small star: the same
    for the node itself and the neighbours that are smaller. Edges that occur several times between the steps do no harm, since only least values count.
    """
    sides = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _least(sides).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    both = F.array(*(F.struct(F.col(c).alias("u"), F.col("low").alias("v")) for c in "uv"))
    return _least(large).select(F.inline(both)).where("u <> v").distinct()


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a lesser node, or only edges to greater ones: then the lesser nodes are the labels."""
    ends = edges.select(F.inline(F.array(*(F.struct(F.col(c).alias("node"), F.lit(c == "u").alias("leaf")) for c in "uv"))))
    nodes = ends.groupBy("node").agg(F.count_if("leaf").alias("leaves"), F.count_if(~F.col("leaf")).alias("hubs"))
    return not nodes.agg(F.coalesce(F.bool_or((F.col("leaves") > 1) | (F.col("leaves") > 0) & (F.col("hubs") > 0)), F.lit(False))).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """The component of each linked node.

    :param edges: columns ``a`` and ``b`` (long); order, repeats, loops and nulls do not matter.
    :return: ``node``, ``label``: each node of a link with another node, and the least node it can reach.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    # forests of what a task made, and again of what a task reads of the written edges: a table of few files is done by then
    current = stash(_forests(stash(_forests(links).distinct())))
    while not _is_stars(current):
        current = stash(_contracted(current))
    return current.select(F.col("u").alias("node"), F.col("v").alias("label")).union(current.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
