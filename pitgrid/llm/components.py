"""Connected components as a distributed union-find: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitgrid.llm.common import drop_stash, stash


def _large_star(links: DataFrame) -> DataFrame:
    """Every neighbour above a node is hung under the least node of the neighbourhood."""
    both = links.select(F.col("child").alias("u"), F.col("parent").alias("v")).union(links.select("parent", "child"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("child"), F.col("m").alias("parent")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and all below it are hung under the least of them."""
    least = links.groupBy("child").agg(F.min("parent").alias("m"))
    below = links.join(least, "child").where("parent > m").select(F.col("parent").alias("child"), F.col("m").alias("parent"))
    return below.union(least.select("child", F.col("m").alias("parent"))).distinct()


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.expr("bit_xor(xxhash64(child, parent))"), F.expr("sum(cast(xxhash64(child, parent) as decimal(38,0)))")).first())


def connected_components(links: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """links: undirected edges of longs (null ends and loops are ignored). Returns (node, root) for every node that is
    not the least of its component; root is that least node. No links give an empty table. Each round is a written
    table in the shared folder, so a lost executor costs one round at most. Two aggregations and two joins a round,
    pre-aggregated by minimum: a node with very many neighbours is no hot spot.
    """
    start = links.where(f"{a} is not null and {b} is not null and {a} <> {b}")
    now = stash(start.select(F.greatest(a, b).alias("child"), F.least(a, b).alias("parent")).distinct())
    mark = _mark(now)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        new = stash(_small_star(_large_star(now)))
        drop_stash(now)
        now, before, mark = new, mark, _mark(new)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components have not settled in {max_rounds} rounds")
    return now.select(F.col("child").alias("node"), F.col("parent").alias("root"))
