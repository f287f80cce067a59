"""Connected components of a graph that is too large for one task.

Alternating large-star and small-star steps: each links neighbours to the
least node seen, so that every component ends as a star around its least node
in about log(n) rounds. A hub's many neighbours never meet in one row; steps
are joins and minimum aggregates, each written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import written


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of ``edges`` (a long, b long); root is the least node reachable."""
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .filter("a <> b").distinct(), "cc")
    last = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "cc_least")
        # large star: greater neighbours of a node go to the least of its neighbourhood
        large = written(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(),
                        "cc_large")
        # small star: lesser neighbours of a node, and itself, go to the least of them
        low = written(large.groupBy("a").agg(F.min("b").alias("m")), "cc_low")
        small = (large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        edges = written(small, "cc")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        last = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
