"""Connected components of an edge table: few edges in one task, others by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from joblore.llm.scratch import discard, stash

#: Edges that one task joins at most, with about 360 bytes each; more go by rounds of star steps.
FEW = 200_000


class Forest:
    """Union-find."""

    def __init__(self):
        self.above: dict = {}

    def root(self, x):
        while (up := self.above.get(x, x)) != x:
            self.above[x] = self.above.get(up, up)
            x = up
        return x

    def join(self, a, b) -> bool:
        """Whether a and b were apart."""
        a, b = self.root(a), self.root(b)
        if a != b:
            self.above[max(a, b)] = min(a, b)
        return a != b


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (node, component) of the edges (u, v) of one task."""
    forest, nodes = Forest(), set()
    for batch in batches:
        for u, v in zip(*(batch.column(c).to_pylist() for c in ("u", "v")), strict=True):
            forest.join(u, v)
            nodes.update((u, v))
    found = list(nodes)
    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array([forest.root(x) for x in found], pa.int64())], ["node", "component"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of some edge; component is its least node reachable.

    Self-loops and null ends are ignored. Each round is two aggregations with joins back, so a
    node with very many edges is no single task's work; rounds grow with the logarithm of the size. A round costs
    several shuffles however few its edges are, so up to FEW are joined at once.
    """
    now = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    raw = stash(now, "edges")
    if raw.count() <= FEW:
        return raw.coalesce(1).mapInArrow(_joined, "node long, component long")
    now, before = stash(raw.distinct(), "edges"), None
    discard(raw)
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stash(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        step = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        told, old = Observation(), now  # counted while they are written
        now = stash(step.select("e.*").filter("u != v").distinct().observe(told, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "edges")
        state = told.get
        discard(old, large)
        if state == before:
            break
        before = state
    else:
        if before:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
