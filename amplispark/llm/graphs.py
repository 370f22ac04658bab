"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amplispark.llm.common import Workspace


def components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """(node, component) for every node of the (a, b) edges; a component bears its smallest node.

    Alternating large and small stars: each node hands its neighbours on to the
    smallest of them, until every component is a star around its smallest node.
    The number of rounds grows with the logarithm of the longest path; each
    round is a written table, so that a lost executor never costs more than one.
    """
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    down = lambda e: e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    path = ws.write(down(edges))
    state = None
    while True:
        at = ws.spark.read.parquet(path)
        new_state = at.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()  # 64 bits of every edge
        if new_state == state or not new_state[0]:
            break
        state = new_state
        near = both(at)
        least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = near.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = down(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        new = ws.write(down(small))
        ws.drop(path)
        path = new
    stars = ws.spark.read.parquet(path)
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
