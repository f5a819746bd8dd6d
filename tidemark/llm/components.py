"""Connected components of links by alternating large and small stars.

Each round is a few aggregations and joins by key, so no task holds a component and none reaches the driver;
lineage is cut after every round. Links are first contracted within each partition by union-find. Where that leaves FEW
links at most, which are counted, one task contracts them to the end: rounds would cost more than that.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


#: Links that one task may hold (some tens of MB).
FEW = 200_000


def forest(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Links (node, smallest node of its component) that connect what the links a-b connect."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a, b, strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    pairs = [(x, r) for x in parent if (r := root(x)) != x]
    return [x for x, _ in pairs], [r for _, r in pairs]


def contract(links: DataFrame) -> DataFrame:
    """Fewer links with the same components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []
        for batch in batches:
            a, b = forest(a + batch.column(0).to_pylist(), b + batch.column(1).to_pylist())
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return links.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(run, "a long, b long")


def _star(links: DataFrame, large: bool) -> DataFrame:
    """large: what stands above a node goes to its least neighbour; else a node and what stands below it do."""
    both = links.union(links.select("b", "a")).toDF("u", "v") if large else links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # Cut off from its aggregation, so that Spark can split the links of a node that has very many.
    joined = both.join(checkpoint(least), "u")
    if large:
        moved = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    return moved.filter(F.col("a") != F.col("b")).distinct()


def _settled(links: DataFrame) -> bool:
    """If every node stands above one other at most and none both above and below."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("b", F.lit(0), F.lit(1)))
    odd = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))
    return odd.isEmpty()


def _labelled(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(stars.select("b", "b").distinct())


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node and component (its smallest member) of every node of links (columns a and b of longs)."""
    now = checkpoint(contract(links).distinct())
    if now.count() <= FEW:
        return _labelled(checkpoint(contract(now.coalesce(1))))
    for _ in range(rounds):
        if _settled(now):
            return _labelled(now)
        now = checkpoint(_star(_star(now, True), False))
    raise RuntimeError("components have not settled")
