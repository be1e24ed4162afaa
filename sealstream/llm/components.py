"""Connected components of a graph held as edges, for any number of nodes and any degree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealstream.llm.common import lookup
from sealstream.operators.plan import staged


def _sum_of(edges: DataFrame) -> tuple:
    """Number and hash sum of the edges: tells whether a round changed them."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component: the smallest node reachable. Nodes that are their own component's smallest are left out.

    Alternating large-star and small-star rounds, which take a number of rounds that grows with the logarithm of
    the longest path. Every round is a few joins of narrow rows; nodes of high degree are handled
    by ``lookup``. Edges are staged after each round, so a lost executor repeats one step.
    """
    rows = edges.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).filter("high <> low")
    now = staged(rows.distinct())
    seen = _sum_of(now)
    while seen[0]:
        ends = now.select(F.col("high").alias("at"), F.col("low").alias("to")).unionByName(
            now.select(F.col("low").alias("at"), F.col("high").alias("to")))
        least = staged(ends.groupBy("at").agg(F.least(F.min("to"), F.col("at")).alias("least"),
                                              F.count("*").alias("degree")))
        large = lookup(now.select(F.col("low").alias("at"), F.col("high").alias("to")), least, ["at"], "degree", ["to"])
        mid = staged(large.select(F.col("to").alias("high"), F.col("least").alias("low")).distinct())
        least = staged(mid.groupBy("high").agg(F.min("low").alias("least"), F.count("*").alias("degree")))
        small = lookup(mid, least, ["high"], "degree", ["low"])
        now = staged(small.select(F.col("low").alias("high"), F.col("least").alias("low")).filter("high <> low")
                     .unionByName(least.select("high", F.col("least").alias("low"))).distinct())
        after = _sum_of(now)
        if after == seen:
            break
        seen = after
    return now.select(F.col("high").alias("node"), F.col("low").alias("component"))
