"""Connected components of an edge table by hooking to the smallest neighbour, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import settle


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of the edges (a, b): comp is the smallest node that it reaches.

    Each round hooks every node to its smallest neighbour, jumps pointers until all point to roots, and contracts the
    edges, of which at most half the nodes remain. All tables are distributed; each round is written, so a lost executor
    costs one round at most. Null ends and loops are dropped; an empty table gives an empty one."""
    live = settle(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    found = None
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")).select("node", F.least("node", "up").alias("up"))
        hooks = _jump(settle(hooks, "hooks"))
        if found is None:
            found = hooks.withColumnRenamed("up", "comp")
        else:
            moved = hooks.select(F.col("node").alias("comp"), "up")
            found = settle(found.join(moved, "comp", "left").select("node", F.coalesce("up", "comp").alias("comp")), "labels")
        end = lambda c: hooks.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up"))
        left = live.join(end("a"), "a").join(end("b"), "b").where("a_up <> b_up")
        live = settle(left.select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct(), "edges")
    return found if found is not None else live.select(F.col("a").alias("node"), F.col("b").alias("comp"))


def _jump(hooks: DataFrame) -> DataFrame:
    """Points every node to its root. hooks: (node, up), up <= node; roots point to themselves."""
    while True:
        up = hooks.where("node <> up").select(F.col("node").alias("up"), F.col("up").alias("upper"))
        moved = settle(hooks.join(up, "up", "left").select("node", F.coalesce("upper", "up").alias("up"),
            F.col("upper").isNotNull().alias("moved")), "hooks")
        hooks = moved.select("node", "up")
        if moved.where("moved").isEmpty():
            return hooks
