"""Connected components of a link table, without gathering links anywhere.

Alternating stars: every node points its larger neighbours to the smallest one it knows, then the smaller
ones.  Each round is written to the shared folder.  Links of a node with very many neighbours are reduced
by partial minima, and the join that returns them can be split.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import materialize

ROUNDS = 60


class Forest:
    """Union-find over any keys; the smallest key of a tree is its root."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        up, top = self.up, x
        while (y := up.get(top, top)) != top:
            top = y
        while (y := up.get(x, x)) != top:
            up[x], x = top, y
        return top

    def join(self, x, y) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def thin(links: DataFrame) -> DataFrame:
    """Links (a, b) of each task reduced to a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                forest.join(a, b)
        pairs = [(x, forest.root(x)) for x in list(forest.up)]
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])

    return links.select("a", "b").mapInArrow(run, "a long, b long").where("a != b")


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of a link with another node; links are (a, b), long."""
    edges = materialize(thin(links.where("a is not null and b is not null and a != b")), "links")
    last = None
    for _ in range(ROUNDS):
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
        edges = materialize(small.select(F.col("e.a").alias("a"), F.col("e.m").alias("b")).where("a != b").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            roots = edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
            tops = roots.select(F.col("component").alias("node"), "component").distinct()
            return roots.union(tops)
        last = now
    raise RuntimeError(f"links do not settle in {ROUNDS} rounds")
