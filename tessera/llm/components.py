"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def _forest(batches):
    """A task's edges as a forest: each node with the least node that the task's edges link it to."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := parent.get(x, x)) != x:
            parent[x] = x = parent.get(y, y)
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(a), top(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for at in range(0, len(nodes), 100_000):
        some = nodes[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([top(x) for x in some], pa.int64())], ["a", "b"])


def _unsettled(edges: DataFrame) -> bool:
    """Whether a node has two edges upward, or one upward and one from below: then the stars are not whole yet."""
    up, down = edges.select(F.col("a").alias("u"), F.lit(2).alias("k")), edges.select(F.col("b").alias("u"), F.lit(1).alias("k")).distinct()
    return bool(up.unionByName(down).groupBy("u").agg(F.sum("k").alias("k")).filter("k > 2").head(1))


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``comp`` (the smallest node it is linked to) for the nodes of ``edges`` (a, b); loops are ignored.

    Each task's edges become a forest, then the stars contract. Each step is written to the shared folder. It is over when
    each node has one edge, to a node that has none.
    """
    now = stage(edges.filter("a <> b").select("a", "b").mapInArrow(_forest, "a long, b long").distinct(), "stars")
    while _unsettled(now):
        now = stage(_small_star(_large_star(now)), "stars")
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp"))
