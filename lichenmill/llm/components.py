"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round on (u, v) rows; each node's smallest neighbour is found by a partial aggregation."""
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    if large:
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.where("u <> v").distinct()
    down = both.where(F.col("v") < F.col("u"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    kids = down.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kids.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the smallest node reachable) for every node of ``edges`` (u, v); isolated nodes are not listed."""
    now = materialize(edges.select("u", "v").where("u <> v").distinct(), "edges")
    seen = None
    for _ in range(rounds):
        now = materialize(_star(_star(now, True), False), "stars")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
