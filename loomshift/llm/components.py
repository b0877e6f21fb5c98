"""Connected components of an edge table: local forests, then alternating large-star and small-star rounds.

Tasks of a bounded number of edges replace theirs by a forest, so graphs up to that number are done at once. Every round
after that is a few joins on node ids and is stored, so a lost executor repeats one round at most. Minima are taken
with partial aggregation; the join back to a busy node is one that adaptive execution can split.
"""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomshift.llm.common import Scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TASK_EDGES = 200_000  # edges that a task replaces by a forest, about


class Forest:
    """Union-find over numbers."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self):
        return [(x, self.root(x)) for x in self.up if self.root(x) != x]


def contracted(batches):
    """Edges to those of a forest that joins the same nodes."""
    forest = Forest()
    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(u, v)
    edges = forest.edges()
    if edges:
        u, v = zip(*edges, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def flat(edges: DataFrame) -> bool:
    """Whether every node hangs on one root, which hangs on nothing."""
    inner = edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
    return inner.isEmpty() and edges.groupBy("u").count().filter("count > 1").isEmpty()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """`edges` (u, v) to (node, root): the smallest node of the component, for every node that has an edge."""
    given = scratch.store(edges.filter("u != v").select("u", "v"))
    tasks = max(1, -(-given.count() // TASK_EDGES))
    held = scratch.store(given.coalesce(tasks).mapInArrow(contracted, "u long, v long"))
    scratch.drop(given)
    while not flat(held):
        both = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = scratch.store(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = scratch.store(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop(held, large)
        held = small
    # roots have no edge to a smaller node
    return held.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        held.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
