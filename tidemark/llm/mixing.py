"""Mixing sources to target weights as a min-cost flow over membership patterns.

A document may belong to several sources. Documents are aggregated by membership pattern; a flow routes each pattern's
words to the quotas of its sources, where the first pass over a pattern's words is free, the second costs 1, and so on
(convex repetition costs), so words repeat only where quotas need it. The flow runs over patterns and sources, a table
whose size does not grow with the documents. Then documents are selected: within a pattern and source, in the order of a
seeded hash, whole documents until the routed words are reached; repeats are whole further passes. Finding the last
document of a selection takes two histograms of hash prefixes and a window over one prefix, so no source, however large,
is ordered in one task.

Null texts have no words and are never taken. A null source is a source of its own, last in the order. Equal hashes are
ordered by doc_id; repeated rows with one doc_id share their hash, and are taken in the order of their size. An empty table
gives an empty table; columns that clash with the result's names are replaced.
"""

from __future__ import annotations

import json
from collections import deque
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, settle

#: Repeats of a document at most, weights of the sources by code point order, all targets as a part of all words.
MAX_PASSES, WEIGHTS, TOTAL = 2, (3, 1, 2), Fraction(3, 2)
#: Hexadecimal digits of the hash that a histogram resolves; at most so many membership patterns are routed.
DIGITS, MAX_PATTERNS = 3, 100_000


def capped_targets(sizes: list[int], weights: list[int], total: Fraction = TOTAL, cap: int = MAX_PASSES) -> list[float]:
    """total x all words shared by weight; a source stops at cap times its size, the excess is shared again."""
    want, out, free = total * sum(sizes), [Fraction(0)] * len(sizes), set(range(len(sizes)))
    while free:
        rest = want - sum(out)
        weight = sum(weights[k] for k in free)
        share = {k: rest * weights[k] / weight for k in free}
        full = {k for k in free if share[k] > cap * sizes[k]}
        if not full:
            for k in free:
                out[k] = share[k]
            break
        for k in full:
            out[k] = Fraction(cap * sizes[k])
        free -= full
    return [float(x) for x in out]


def min_cost_flow(supply: list[int], members: list[list[int]], quota: list[int], passes: int = MAX_PASSES) -> list[dict[int, int]]:
    """Words of each pattern routed to each of its sources: as much of the quotas as can be met, at the least repetition.

    Successive shortest augmenting paths. The only costs are those of the passes (0, 1, 2, ...), so paths are searched for
    one pass after the other, by breadth first: pattern, source, back over a flow to another pattern, and so on.
    """
    flow: list[dict[int, int]] = [dict.fromkeys(m, 0) for m in members]
    left = list(quota)
    by_source: dict[int, list[int]] = {}
    for p, own in enumerate(members):
        for s in own:
            by_source.setdefault(s, []).append(p)
    for _ in range(passes):
        for p, own in enumerate(members):
            more = supply[p]
            while more > 0:
                came: dict[tuple[str, int], tuple[str, int] | None] = {("p", p): None}
                queue, goal = deque([("p", p)]), None
                while queue and goal is None:
                    kind, x = node = queue.popleft()
                    if kind == "p":
                        for s in members[x]:
                            if ("s", s) not in came:
                                came["s", s] = node
                                queue.append(("s", s))
                    elif left[x] > 0:
                        goal = node
                    else:
                        for q in by_source[x]:
                            if flow[q][x] > 0 and ("p", q) not in came:
                                came["p", q] = node
                                queue.append(("p", q))
                if goal is None:
                    break
                path = [goal]
                while came[path[-1]] is not None:
                    path.append(came[path[-1]])
                path.reverse()
                moved = min([more, left[goal[1]], *(flow[b[1]][a[1]] for a, b in zip(path, path[1:]) if a[0] == "s")])
                for a, b in zip(path, path[1:]):
                    if a[0] == "p":
                        flow[a[1]][b[1]] += moved
                    else:
                        flow[b[1]][a[1]] -= moved
                left[goal[1]] -= moved
                more -= moved
    return flow


def _cut(rows: DataFrame, key: list[str], at: str) -> DataFrame:
    """By key: the histogram slot in which the running size passes at, and the size before it. rows: key, slot, size, at."""
    w = Window.partitionBy(*key).orderBy("slot")
    run = rows.select("*", F.sum("size").over(w).alias("upto"))
    return run.where((F.col("upto") >= F.col(at)) & (F.col("upto") - F.col("size") < F.col(at))).select(*key, F.col("slot").alias("cut"),
        (F.col(at) - F.col("upto") + F.col("size")).alias("still"))


def _ends(sized: DataFrame, wanted: DataFrame) -> DataFrame:
    """By lane: the hash prefix in which the selection ends, and its last document. wanted: (lane, rest, passes)."""
    first, second = F.substring("h", 1, DIGITS), F.substring("h", DIGITS + 1, DIGITS)
    live = sized.join(F.broadcast(wanted.select("lane", "rest").where("rest > 0")), "lane")
    c1 = _cut(live.groupBy("lane", "rest", first.alias("slot")).agg(F.sum("size").alias("size")), ["lane"], "rest")
    in1 = live.join(F.broadcast(c1.select("lane", F.col("cut").alias("slot1"), "still")), "lane").where(first == F.col("slot1"))
    c2 = _cut(in1.groupBy("lane", "slot1", "still", second.alias("slot")).agg(F.sum("size").alias("size")), ["lane", "slot1"], "still")
    in2 = in1.drop("still").join(F.broadcast(c2.select("lane", F.col("cut").alias("slot2"), "still")), "lane").where(second == F.col("slot2"))
    order = Window.partitionBy("lane").orderBy("h", "doc_id", "size")
    last = in2.select("lane", "still", "h", "doc_id", "size", F.sum("size").over(order).alias("upto"))
    before = F.col("upto") - F.col("size")
    last = last.where((before < F.col("still")) & ((F.col("upto") <= F.col("still")) | (F.col("upto") - F.col("still") <= F.col("still") - before)))
    end = last.groupBy("lane").agg(F.max(F.struct("h", "doc_id", "size")).alias("end"))
    return wanted.join(c2.select("lane", F.concat("slot1", "cut").alias("prefix")), "lane", "left").join(end, "lane", "left")


def _narrow(docs: DataFrame, source: str, seed: str) -> list[Column]:
    """doc_id, size, lane and h of a row: what the mix depends on."""
    names = F.col(f"`{source}`") if dict(docs.dtypes)[source].startswith("array") else F.array(F.col(f"`{source}`"))
    doc = F.col("doc_id").cast("long")
    return [
        doc.alias("doc_id"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.to_json(F.sort_array(F.array_distinct(names)), {"ignoreNullFields": "false"}).alias("lane"),
            F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit("")))).alias("h"),
    ]


def mix(docs: DataFrame, source: str = "source", seed: str = "mix") -> DataFrame:
    """docs with size, source_size, target and taken (words, repeats counted). source is a column of names or of arrays of
    names; for an array, source_size and target are those of all its sources together.

    Only (doc_id, size, sources, hash) of each row is written and aggregated; texts are not shuffled."""
    spark = docs.sparkSession
    sized = settle(docs.select(*_narrow(docs, source, seed)), "mix")
    found = sized.groupBy("lane").agg(F.sum("size").alias("size")).orderBy("lane").limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"over {MAX_PATTERNS} membership patterns")
    patterns = [json.loads(r["lane"]) for r in found]
    names = sorted({n for p in patterns for n in p}, key=lambda n: (n is None, n or ""))
    at = {n: k for k, n in enumerate(names)}
    members, supply = [[at[n] for n in p] for p in patterns], [r["size"] for r in found]
    sizes = [sum(w for w, m in zip(supply, members) if k in m) for k in range(len(names))]
    targets = capped_targets(sizes, [WEIGHTS[k % len(WEIGHTS)] for k in range(len(names))], TOTAL * Fraction(sum(supply), max(1, sum(sizes))))
    flow = min_cost_flow(supply, members, [round(t) for t in targets])
    plan = []
    for r, own, out in zip(found, members, flow):
        total = sum(out.values())
        passes = total // r["size"] if r["size"] else 0
        plan.append((r["lane"], sum(sizes[k] for k in own), float(sum(targets[k] for k in own)), passes, total - passes * r["size"]))
    wanted = spark.createDataFrame(plan, "lane string, source_size long, target double, passes long, rest long")
    ends = settle(_ends(sized, wanted), "mix-ends")  # a row per pattern
    keep = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    doc, size, lane, h = _narrow(docs, source, seed)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), doc, size, lane, h).join(F.broadcast(ends), "lane", "left")
    once = F.coalesce((F.substring("h", 1, 2 * DIGITS) < F.col("prefix")) | (F.struct("h", "doc_id", "size") <= F.col("end")), F.lit(False))
    return rows.select(*[F.col(f"row.`{c}`") for c in keep], "size", "source_size", "target",
        (F.col("size") * (F.col("passes") + once.cast("long"))).alias("taken"))
