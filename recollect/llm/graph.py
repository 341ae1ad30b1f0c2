"""Connected components of a graph that no machine holds as a whole."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import discard, stored


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")


#: Most edges that one task merges by itself: about 2 MB. It saves rounds of tiny jobs, and its labels are the same.
ONE_TASK = 100_000


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "label"])


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` of every node of ``edges`` (``a``, ``b``): the label is the component's least node.

    Alternates the large-star and small-star steps of the MapReduce algorithm:
    each node's neighbours are linked to its least neighbour, so that paths
    shrink to stars in about log(n) rounds. A round is a join on the node, in
    which Spark splits hot nodes, never a group gathered in one task.
    """
    edges = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    if edges.count() <= ONE_TASK:
        return edges.coalesce(1).mapInArrow(_merged, "node long, label long")
    before = None
    while True:
        # large star: every greater neighbour of u is linked to the least of u and its neighbours
        links = _both(edges)
        least = links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = links.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()
        large = stored(large, "edges-large")
        # small star: u and its lesser neighbours are linked to the least of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b").alias("b")))).alias("e")).select("e.a", "e.b").where("a < b").distinct()
        small = stored(small, "edges-small")
        discard(edges)
        discard(large)
        edges = small
        # a state is told by its number of edges and two sums of their hashes
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
