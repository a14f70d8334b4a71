"""Connected components of an edge table, distributed: large-star and small-star rounds until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, tasks_for


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """edges (a, b) in either direction. Returns (v, c): each node with an edge and the smallest node of its component. Hot nodes stand on the left of a join with one row a node on its right, so adaptive execution can split them."""
    measured = lambda s: s.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
    state = cut(edges.where("a != b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct())
    before = measured(state)
    for _ in range(rounds):
        few = tasks_for(2 * before[0])  # the number of edges hardly grows
        state = state.coalesce(few)
        both = state.select(F.col("v").alias("u"), F.col("m").alias("w")).unionByName(state.select(F.col("m").alias("u"), F.col("v").alias("w")))
        large = _star(both, "w > u").coalesce(few)
        state = cut(_star(large.select(F.col("v").alias("u"), F.col("m").alias("w")), "true").coalesce(few))
        mark = measured(state)
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components not settled in {rounds} rounds")
    return state.select("v", F.col("m").alias("c")).unionByName(state.select(F.col("m").alias("v"), F.col("m").alias("c"))).distinct()


def _star(pairs: DataFrame, which: str) -> DataFrame:
    """Links the neighbours w of each u, and u itself in the small star, to the smallest of them all."""
    least = pairs.groupBy("u").agg(F.least(F.min("w"), F.col("u")).alias("m"))
    out = pairs.join(least, "u").where(which).select(F.col("w").alias("v"), "m")
    if which == "true":
        out = out.unionByName(least.select(F.col("u").alias("v"), "m"))
    return out.where("v != m").distinct()
