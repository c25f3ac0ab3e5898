"""Connected components by alternating large-star and small-star steps.

Edges are first contracted inside each partition (a star for each local component); then each
round joins every node to the least neighbour it knows, until nothing changes.  Every round is
written to the shared folder, so lineage stays short and a lost executor costs a reread.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridoc.llm.common import stored

EDGES = "u bigint, v bigint"


class Forest:
    """Union-find over hashable nodes; a root is the least of its tree."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def contract(batches):
    """A star for each component among blocks of at most a million edges."""
    def out(forest):
        pairs = [(x, forest.find(x)) for x in list(forest.up)]
        u, v = np.array([p for p in pairs if p[0] != p[1]], np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    forest, n = Forest(), 0
    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            forest.join(u, v)
        n += b.num_rows
        if n >= 1_000_000:
            yield out(forest)
            forest, n = Forest(), 0
    if forest.up:
        yield out(forest)


def connected(edges: DataFrame, contracted: bool = False) -> DataFrame:
    """edges: u, v (bigint).  node, root: the least node of its component, for every node with an edge.
    ``contracted``: the edges come from ``contract`` already, so that no second Python worker runs behind the one that finds them."""
    if not contracted:
        edges = edges.select(F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v")).where("u <> v").mapInArrow(contract, EDGES)
    e = stored(edges, "edges")
    state = None
    while True:
        # Large star: every neighbour above the node moves to the least of them all.
        both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: the node and its lower neighbours move to the least of these.
        low = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        base = low.groupBy("u").agg(F.min("v").alias("m"))
        small = low.join(base, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(base.select("u", F.col("m").alias("v"))).distinct()
        e = stored(small, "edges")
        r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first()
        if state == tuple(r):
            return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        state = tuple(r)
