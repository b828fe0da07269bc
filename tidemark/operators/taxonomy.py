"""Trees given as (categoryid, parentid): closure, depth, root and path, and structure checks, by pointer doubling.

Each round doubles the distance that a node's pointer spans, so a tree of any depth takes as many rounds as its depth has
bits. A round is one join, and is written: no plan grows with the rounds, and a lost executor costs one round at most. A key
with several parents goes by the smallest (no parent comes first); it is reported as a duplicate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scratch import written


def parents(tree: DataFrame) -> DataFrame:
    """One row per key: categoryid, parentid."""
    return tree.groupBy("categoryid").agg(F.min(F.struct("parentid")).alias("p")).select("categoryid", F.col("p.parentid").alias("parentid"))


def _doubled(tree: DataFrame, paths: bool = False, circles: bool = False) -> tuple[DataFrame, DataFrame]:
    """(reached, circling). reached: of every node that a root reaches its root, depth, the child of the root that it is under (a
    root: itself) and, if asked for, path. circling: the nodes that stay on their way for ever with a node up of their cycle,
    each node of a cycle at least once; complete only if circles is set.

    A pointer spans some steps to up; head and path are the first node and all nodes below up on the way down. It is put
    together with that of up. After k rounds all nodes of a depth below 2^k have their root; where a round brings no node to
    its root, none deeper is left."""
    nodes = lambda c: F.array(c) if paths else F.array().cast("array<bigint>")
    base = parents(tree).select(F.col("categoryid").cast("long").alias("categoryid"), F.col("parentid").cast("long").alias("up"))
    one = F.col("categoryid")
    done = written(base.where("up is null").select("categoryid", one.alias("root"), F.lit(0).alias("depth"), one.alias("child"),
        nodes("categoryid").alias("path")), "roots")
    # a parent that is no key is the end of a way without a root
    live = base.where("up is not null").join(base.select(one.alias("up")), "up", "left_semi")
    live = written(live.select("categoryid", "up", F.lit(1).alias("steps"), one.alias("head"), nodes("categoryid").alias("path")), "pointers")
    span, left = 1, live.count()
    while True:
        top = done.select(one.alias("up"), "root", F.col("depth").alias("_depth"), F.col("child").alias("_child"), F.col("path").alias("_path"))
        child = F.when(F.col("_depth") == 0, F.col("head")).otherwise(F.col("_child"))
        reached = written(live.join(top, "up").select("categoryid", "root", (F.col("_depth") + F.col("steps")).alias("depth"),
            child.alias("child"), F.concat("_path", "path").alias("path")), "reached")
        fresh = reached.count()
        done = done.unionByName(reached)
        onward = live.join(reached.select("categoryid"), "categoryid", "left_anti")
        if fresh == left or not fresh and (not circles or span > left):
            return done, onward.select("categoryid", "up")
        above = live.select(one.alias("up"), F.col("up").alias("_up"), F.col("steps").alias("_steps"), F.col("head").alias("_head"),
            F.col("path").alias("_path"))
        steps, path = F.col("steps"), F.col("path")
        if fresh:  # else only circles are looked for
            steps, path = steps + F.col("_steps"), F.concat("_path", "path")
        live = written(onward.join(above, "up").select("categoryid", F.col("_up").alias("up"), steps.alias("steps"), F.col("_head").alias("head"),
            path.alias("path")), "pointers")
        span, left = 2 * span, live.count()


def with_paths(tree: DataFrame) -> DataFrame:
    """categoryid, depth (roots: 0), root and path (root first) of every node that a root reaches. A path is as long as its node
    is deep; where that is not needed, with_roots does without."""
    return _doubled(tree, paths=True)[0].select("categoryid", "depth", "root", "path")


def with_roots(tree: DataFrame) -> DataFrame:
    """categoryid, depth, root and child (of the root; a root: itself) of every node that a root reaches."""
    return _doubled(tree)[0].select("categoryid", "depth", "root", "child")


def ancestors(tree: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of the tree that the ids (categoryid) or any of their ancestors name; ids that the tree lacks vanish.

    Each round adds the ancestors at the pointers' distance and doubles it; where one adds nothing, the rest is there too."""
    up = written(parents(tree).where("parentid is not null").select("categoryid", F.col("parentid").alias("up")), "pointers")
    found = written(ids.select("categoryid").where("categoryid is not null").distinct(), "closure")
    while True:
        more = found.join(up, "categoryid").select(F.col("up").alias("categoryid")).distinct()
        more = written(more.join(found, "categoryid", "left_anti"), "closure")
        if more.isEmpty():
            return tree.join(found, "categoryid", "left_semi")
        found = found.unionByName(more)
        up = written(up.join(up.select(F.col("categoryid").alias("up"), F.col("up").alias("_up")), "up").select("categoryid",
            F.col("_up").alias("up")), "pointers")


def cycles(tree: DataFrame) -> DataFrame:
    """categoryid of every node that is its own ancestor over two steps or more."""
    return _on_cycles(tree, _doubled(tree, circles=True)[1])


def _on_cycles(tree: DataFrame, circling: DataFrame) -> DataFrame:
    own = parents(tree).where("categoryid = parentid").select("categoryid")
    return circling.select(F.col("up").alias("categoryid")).distinct().join(own, "categoryid", "left_anti")


def defects(tree: DataFrame) -> DataFrame:
    """(kind, findings): duplicate keys, self references, missing parents, nodes on a cycle, nodes that no root reaches."""
    keys = tree.select("categoryid").distinct()
    reached, circling = _doubled(tree, circles=True)
    checks = {
        "duplicate_key": tree.groupBy("categoryid").count().where("count > 1"),
        "self_reference": tree.where("categoryid = parentid"),
        "missing_parent": tree.where("parentid is not null").join(keys.select(F.col("categoryid").alias("parentid")), "parentid", "left_anti"),
        "cycle": _on_cycles(tree, circling),
        "unreachable": keys.join(reached.select("categoryid"), "categoryid", "left_anti"),
    }
    return reduce(DataFrame.union, [df.agg(F.count("*").alias("findings")).select(F.lit(kind).alias("kind"), "findings") for kind,
        df in checks.items()])
