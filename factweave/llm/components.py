"""Connected components with DataFrame operations only.

Alternating large-star and small-star rounds: every round rewires each node to
the smallest id it has seen, so long chains collapse in O(log n) rounds and a
hub's neighbours never meet in one task (minima are partial aggregates; the
join back is a sort-merge join that adaptive execution can split).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, scratch: Scratch, label: str = "cc") -> DataFrame:
    """``edges(u, v)`` -> ``(id, component)`` for every node that is not its own component's smallest.

    Nodes that are absent from the result are the smallest of their component.
    Self loops, repeated edges and an empty table are fine; nulls are dropped.
    """
    held = scratch.save(_small_star(edges.select("u", "v").dropna()), f"{label}0")
    before, n = None, 0
    while True:
        state = held.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            if n:
                scratch.drop(f"{label}{n - 1}")
            return held.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before, n = state, n + 1
        held = scratch.save(_small_star(_large_star(held)), f"{label}{n}")
        if n > 1:
            scratch.drop(f"{label}{n - 2}")
