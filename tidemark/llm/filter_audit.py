"""Filter interaction audit: what each filter removes in every order of a filter chain, by path counts over the subset lattice.

A state of the lattice is the set of filters applied so far, an edge the next filter; an order is a path from the empty set
to the full one. The number of orders that reach a state (forward) times the number that leave the edge's end (backward) is
the number of orders that take the edge. An edge removes the documents that fail its filter and none of its state, whatever
the order in which the state was built, so 2^k states stand for k! orders: a filter's Shapley sum is its edges' removals
weighted by their paths, and the steps of one order are read from the same edges.

Documents come down to cells (part, mask of failed filters) in one pass over the texts: a row of digest, mask and doc_id for
each, labels by doc_id, then counts by digest. A text that a third of all rows hold is counted before its shuffle, and rows
without a doc_id are dealt by their digest.

A null text is empty: it has no words and fails A, and E beside another empty one. A null lang is the empty part. Of rows
with equal texts those with the smallest doc_id are originals (rows that repeat that doc_id too); a missing doc_id is smaller
than any other and has no label. A document is good (toxic) if any of its label rows says so. Extra columns are not used; no
documents give no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, SPACES

MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT, MARKUP = 100, 80, 10, "[#$%&*|]"
#: Filters of an audit at most: its result has a row for every step of the k! orders.
MAX_FILTERS = 7


def text_failures(text: Column) -> list[Column]:
    """Whether a text (not null) fails A (few words), B (repeated words), C (capitals) and D (markup)."""
    bare = F.trim(text, F.lit(SPACES))
    words = F.split(bare, SPACE)
    n = F.when(bare == "", 0).otherwise(F.size(words)).cast("long")
    distinct = F.when(bare == "", 0).otherwise(F.size(F.array_distinct(words))).cast("long")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    return [n < MIN_WORDS, 100 * distinct < MIN_DISTINCT_PERCENT * n, 100 * capitals > MAX_CAPITAL_PERCENT * F.length(text), text.rlike(MARKUP)]


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by lang and failed filters. Bits 0 to 3 of mask are A to D, bit 4 is E."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"),
        F.coalesce("text", F.lit("")).alias("text"))
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(text_failures(F.col("text")))), F.lit(0))
    rows = src.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    rows = rows.groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n"))
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("at"), F.lit(False).alias("none")).agg(
        says("quality").alias("good"), says("toxic").alias("toxic"))
    rows = rows.withColumn("at", F.coalesce("doc_id", F.xxhash64("digest"))).withColumn("none", F.col("doc_id").isNull())
    rows = rows.join(said, ["at", "none"], "left").select("doc_id", "part", "mask", "digest", "n",
        *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    alike = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("low"))
    least = F.min("low").over(Window.partitionBy("digest"))
    alike = alike.withColumn("first", F.when(F.col("low.doc_id").eqNullSafe(least["doc_id"]), F.col("low.n")).otherwise(0))
    kinds = F.explode(F.array(F.struct(F.col("mask"), F.col("first").alias("n")),
        F.struct(F.col("mask").bitwiseOR(F.lit(1 << 4)).alias("mask"), (F.col("n") - F.col("first")).alias("n"))))
    split = alike.select("part", "good", "toxic", kinds.alias("x")).where("x.n > 0")
    count = lambda c: F.sum(F.when(c, F.col("x.n")).otherwise(0))
    return split.groupBy("part", F.col("x.mask").alias("mask")).agg(count(F.lit(True)).alias("n"), count(F.col("good")).alias("good"),
        count(F.col("toxic")).alias("toxic"))


def path_counts(k: int) -> tuple[list[int], list[int]]:
    """For every state of the lattice of k filters, the numbers of orders that reach and that leave it."""
    full = (1 << k) - 1
    reach, leave = [1] + [0] * full, [0] * full + [1]
    for state in range(full + 1):
        for f in range(k):
            if not state >> f & 1:
                reach[state | 1 << f] += reach[state]
    for state in range(full, -1, -1):
        for f in range(k):
            if not state >> f & 1:
                leave[state] += leave[state | 1 << f]
    return reach, leave


def edges(found: DataFrame, k: int) -> DataFrame:
    """(part, state, filter, kept, removed, good_lost, toxic_lost, fails, unique_fails, shapley) for every part and edge.

    found: cells (part, mask, n, good, toxic). A cell meets the edges whose state it has passed by an equi-join with a table
    of 2 k 3^(k-1) rows."""
    if not 1 <= k <= MAX_FILTERS:
        raise ValueError(f"an audit takes 1 to {MAX_FILTERS} filters")
    spark, full = found.sparkSession, (1 << k) - 1
    reach, leave = path_counts(k)
    steps = [(state, f) for state in range(full + 1) for f in range(k) if not state >> f & 1]
    meets = [(mask, state, f, mask >> f & 1 == 1, reach[state] * leave[state | 1 << f]) for mask in range(full + 1) for state, f in steps
        if not mask & state]
    meets = spark.createDataFrame(meets, "mask int, state int, filter int, goes boolean, paths long")
    none = found.select("part").distinct().select("part", F.lit(0).alias("mask"), *[F.lit(0).cast("long").alias(c) for c in ("n", "good", "toxic")])
    met = found.unionByName(none).join(F.broadcast(meets), "mask")  # none: so that every edge is there
    gone = lambda c: F.sum(F.when(F.col("goes"), F.col(c)).otherwise(0))
    out = met.groupBy("part", "state", "filter", "paths").agg(F.sum(F.when(F.col("goes"), 0).otherwise(F.col("n"))).alias("kept"),
        gone("n").alias("removed"), gone("good").alias("good_lost"), gone("toxic").alias("toxic_lost"))
    own = Window.partitionBy("part", "filter")
    at = lambda state: F.sum(F.when(F.col("state") == state, F.col("removed")).otherwise(0)).over(own)
    last = F.expr(f"{full} - shiftleft(1, filter)")
    return out.select("part", "state", "filter", "kept", "removed", "good_lost", "toxic_lost", at(F.lit(0)).alias("fails"),
        at(last).alias("unique_fails"), F.sum(F.col("removed") * F.col("paths")).over(own).alias("shapley"))


def audit(found: DataFrame, names: str) -> DataFrame:
    """A row for each part, order of the filters (a string of their one-letter names) and step, read from the edges."""
    k, rows = len(names), []
    for order in permutations(range(k)):
        state, name = 0, "".join(names[f] for f in order)
        for step, f in enumerate(order):
            rows.append((name, step + 1, state, f))
            state |= 1 << f
    orders = found.sparkSession.createDataFrame(rows, "filter_order string, step int, state int, filter int")
    out = edges(found, k).join(F.broadcast(orders), ["state", "filter"])
    return out.select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails",
        "good_lost", "toxic_lost", "shapley")
