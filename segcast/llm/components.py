"""Connected components of a link table by alternating large-star and small-star rounds.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).  Each round
is two joins; the links and the smallest neighbours are written to the shared
folder, so a hub's links meet a small table in a join whose large partitions
adaptive execution can split.  No neighbour list is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segcast.llm.common import materialise

MAX_ROUNDS = 60


def _star(directed: DataFrame, larger: bool, label: str) -> DataFrame:
    """``directed`` has (u, v). Large star: each larger neighbour to the smallest; small star: the smaller ones and u."""
    least = directed.groupBy("u").agg(F.min("v").alias("m"))
    if larger:
        least = least.withColumn("m", F.least("u", "m"))
    least = materialise(least, f"{label}-min")
    met = directed.join(least, "u")
    if larger:
        out = met.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.filter(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        out = out.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return materialise(out.distinct(), label)


def _print(links: DataFrame) -> tuple:
    """Size and order-free digest of a link table."""
    h = F.pmod(F.xxhash64("a", "b"), F.lit(1 << 30))
    return tuple(links.agg(F.count(F.lit(1)), F.sum(h), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 30)))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: longs); the root is the smallest node of its component.

    Nodes without a link do not appear; self-links are ignored; an empty table gives no rows.
    """
    links = links.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    seen = None
    for _ in range(MAX_ROUNDS):
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both, True, "large-star")
        links = _star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), False, "small-star")
        now = _print(links)
        if now == seen:
            root = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(root)
        seen = now
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
