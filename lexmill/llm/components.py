"""Connected components of an edge table by hooking and pointer jumping.

Every round contracts the graph: each vertex hooks on to its least neighbour,
chains of hooks are shortened to their roots, and the edges are rewritten to
roots, dropping those inside a set. Only aggregations with map-side combining
and equi-joins against tables with unique keys are used, so a hub vertex costs
one row per map task; every round's small tables are cut by a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for each vertex of ``edges(a, b)``; component is the least vertex reachable.

    Loops and repeated edges are allowed; an empty edge table gives an empty result.
    """
    least, most = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    live = cut(edges.where("a <> b").select(least, most).distinct())
    label: DataFrame | None = None
    for _ in range(rounds):
        if live.isEmpty():
            break
        hooks = cut(live.groupBy("b").agg(F.min("a").alias("up")))
        while True:
            jumped = hooks.alias("x").join(hooks.alias("y"), F.col("x.up") == F.col("y.b"), "left").select(
                F.col("x.b").alias("b"), F.coalesce("y.up", "x.up").alias("up"), F.col("y.up").isNotNull().alias("moved")
            )
            jumped = cut(jumped)
            hooks = jumped.select("b", "up")
            if jumped.where("moved").isEmpty():
                break
        tail = hooks.select("b", "up")
        if label is None:
            label = tail.select(F.col("b").alias("node"), F.col("up").alias("component"))
        else:
            label = label.join(tail, label.component == tail.b, "left").select(
                "node", F.coalesce("up", "component").alias("component")
            ).unionByName(tail.select(F.col("b").alias("node"), F.col("up").alias("component")))
        label = cut(label)
        at = hooks.select(F.col("b").alias("ha"), F.col("up").alias("ua"))
        to = hooks.select(F.col("b").alias("hb"), F.col("up").alias("ub"))
        moved = live.join(at, live.a == at.ha, "left").join(to, live.b == to.hb, "left").select(
            F.coalesce("ua", "a").alias("a"), F.coalesce("ub", "b").alias("b")
        )
        live = cut(moved.where("a <> b").select(least, most).distinct())
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    if label is None:
        return edges.sparkSession.createDataFrame([], "node long, component long")
    roots = label.select(F.col("component").alias("node"), "component").distinct()
    return label.unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))
