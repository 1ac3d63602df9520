"""Connected components of a graph given as a table of links, without bringing links or labels to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

#: Links that one task finishes at once, a few MB; more are contracted in rounds first.
FEW = 50_000


def _finish(edges: DataFrame) -> DataFrame:
    """(label, to): the smallest node that each node of at most FEW links is joined with, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root.setdefault(root[x], root[x])
            return x

        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
        if root:
            yield pa.RecordBatch.from_arrays([pa.array(list(root), pa.int64()), pa.array([find(x) for x in list(root)], pa.int64())], names=["label", "to"])

    return edges.select("a", "b").repartition(1).mapInArrow(run, "label long, to long")


def components(links: DataFrame, few: int = FEW) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b); a component is named by its smallest node.

    Every node joins the neighbour, or itself, that comes first in a random order, and links are contracted, until few enough
    are left for one task. With a random order a round removes a constant share of the nodes that still have links, whatever
    the graph's shape, and dense groups collapse in a round or two. Each round is checkpointed, so lost executors cost one round at
    most.
    """
    first = lambda c: F.struct(F.xxhash64(F.col(c)).alias("h"), F.col(c).alias("n"))
    edges = cut_lineage(links.select("a", "b").where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node"))
    while edges.count() > few:
        both = edges.union(edges.select("b", "a"))
        joins = both.groupBy("a").agg(F.min(first("b")).alias("to")).select("a", F.least("to", first("a"))["n"].alias("to"))
        joins = cut_lineage(joins)
        labels = cut_lineage(labels.join(joins.withColumnRenamed("a", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label")))
        left, right = joins.select("a", F.col("to").alias("x")), joins.select(F.col("a").alias("b"), F.col("to").alias("y"))
        moved = edges.join(left, "a").join(right, "b").where("x != y")
        edges = cut_lineage(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    labels = cut_lineage(labels.join(_finish(edges), "label", "left").select("node", F.coalesce("to", "label").alias("label")))
    names = labels.groupBy("label").agg(F.min("node").alias("component"))
    return cut_lineage(labels.join(names, "label").select("node", "component"))
