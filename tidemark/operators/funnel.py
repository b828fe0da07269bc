"""Ordered funnels as a fold: steps are summed up by group and hour, and the hours' summaries are put together in their order.

A session that holds a large part of all events is so dealt to as many tasks as it has hours; no window or list goes over a
whole group's events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3_600_000_000


def _at(event: str):
    return F.when(F.col("event") == event, F.col("us"))


def summaries(events: DataFrame, keys: list[str], slice_us: int = HOUR) -> DataFrame:
    """One row per group and slice of time: first view, cart and transaction (tv, tc, tx), last cart and transaction, first cart
    after the first view (fc), first transaction after that (fx) and after the first cart (xt), all within the slice."""
    e = events.select(*keys, F.expr(f"us div {slice_us}").alias("slice"), "us", "event")
    own = Window.partitionBy(*keys, "slice")
    e = e.withColumn("tv", F.min(_at("view")).over(own)).withColumn("tc", F.min(_at("addtocart")).over(own))
    e = e.withColumn("fc", F.min(F.when(F.col("us") > F.col("tv"), _at("addtocart"))).over(own))
    return e.groupBy(*keys, "slice").agg(
        F.min("tv").alias("tv"), F.min("tc").alias("tc"), F.min(_at("transaction")).alias("tx"), F.max(_at("addtocart")).alias("last_tc"),
        F.max(_at("transaction")).alias("last_tx"), F.min("fc").alias("fc"),
        F.min(F.when(F.col("us") > F.col("fc"), _at("transaction"))).alias("fx"),
        F.min(F.when(F.col("us") > F.col("tc"), _at("transaction"))).alias("xt"),
    )


def steps(events: DataFrame, keys: list[str], slice_us: int = HOUR) -> DataFrame:
    """Per group: first view (tv), first cart (tc), last cart, last transaction, first valid cart (fc: after the first
    view), first transaction after that (fx). Steps are strict: equal times are no order.

    The slices of a group follow each other, so the first cart after the first view is that of the view's slice or else the
    first one of a later slice; likewise the transaction after it. Windows are over one row per group and hour."""
    s = summaries(events, keys, slice_us).select("*", F.lit(slice_us).alias("_us"))
    group = Window.partitionBy(*keys)
    first = lambda c: F.min(c).over(group)
    of = lambda c: F.expr(f"{c} div _us")
    s = s.withColumn("_tv", first("tv"))
    cart = F.when(F.col("slice") == of("_tv"), F.col("fc")).when(F.col("slice") > of("_tv"), F.col("tc"))
    s = s.withColumn("_fc", first(cart))
    # within its slice the valid cart is the one after the view, or the first one
    bought = F.when(F.col("_fc") == F.col("fc"), F.col("fx")).when(F.col("_fc") == F.col("tc"), F.col("xt"))
    after = F.when(F.col("slice") == of("_fc"), bought).when(F.col("slice") > of("_fc"), F.col("tx"))
    return s.withColumn("_fx", after).groupBy(*keys).agg(F.min("tv").alias("tv"), F.min("tc").alias("tc"), F.max("last_tc").alias("last_tc"),
        F.max("last_tx").alias("last_tx"), F.min("_fc").alias("fc"), F.min("_fx").alias("fx"))


#: Numerator and denominator of each rate, over steps().
RATES = {
    "ordered_view_to_cart_rate": ("last_tc > tv", "tv is not null"),
    "ordered_cart_to_purchase_rate": ("last_tx > fc", "fc is not null"),
    "ordered_view_to_purchase_rate": ("last_tx > tv", "tv is not null"),
    "cart_abandonment_rate": ("tc is not null and (last_tx is null or last_tx <= tc)", "tc is not null"),
}


def rates(steps_df: DataFrame, which: dict[str, tuple[str, str]] = RATES) -> DataFrame:
    """One row per rate: metric_id, numerator, denominator. One pass over the groups."""
    counts = [F.count_if(F.expr(x)).alias(f"{m}_{k}") for m, pair in which.items() for k, x in enumerate(pair)]
    row = steps_df.agg(*counts)
    return row.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric_id"), F.col(f"{m}_0").alias("numerator"),
        F.col(f"{m}_1").alias("denominator")) for m in which])).alias("x")).select("x.*")


def turns(events: DataFrame, keys: list[str], slice_us: int = HOUR) -> DataFrame:
    """(keys, place, event): each group's events in the order of time and event_id, without those that repeat the one before;
    place counts from 1. The last event and the number of turns of the slices before are carried over a row per slice."""
    e = events.select(*keys, F.expr(f"us div {slice_us}").alias("slice"), "us", "event_id", "event")
    own, group = Window.partitionBy(*keys, "slice").orderBy("us", "event_id"), Window.partitionBy(*keys).orderBy("slice")
    e = e.withColumn("_prev", F.lag("event").over(own)).withColumn("_turn", (~F.col("_prev").eqNullSafe(F.col("event"))).cast("int"))
    e = e.withColumn("_place", F.sum("_turn").over(own))
    order = F.struct("us", "event_id")
    s = e.groupBy(*keys, "slice").agg(F.min_by("event", order).alias("_first"), F.max_by("event", order).alias("_last"), F.sum("_turn").alias("_n"))
    s = s.withColumn("_again", F.coalesce(F.lag("_last").over(group) == F.col("_first"), F.lit(False)).cast("int"))
    before = group.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_before", F.coalesce(F.sum(F.col("_n") - F.col("_again")).over(before), F.lit(0)))
    out = e.where("_turn = 1").join(s.select(*keys, "slice", "_again", "_before"), [*keys, "slice"])
    place = (F.col("_before") + F.col("_place") - F.col("_again")).alias("place")
    return out.where(~((F.col("_again") == 1) & (F.col("_place") == 1))).select(*keys, place, "event")


#: Turns of a path whose text is made at once.
STRETCH = 10_000


def main_paths(turned: DataFrame, keys: list[str], n: int | None = None, counts: dict[str, Column] | None = None) -> DataFrame:
    """(path, sessions): the n most frequent paths of turns(), or all, of equally frequent ones those of fewer turns, then by text.
    counts: what is counted over a path's groups, by columns of keys, the first one for the order; the number of groups by default.

    A path is known by its number of turns and two order-free sums of hashes of its (place, event), so groups are counted
    without their lists; the text is made only of one group for each path that may be shown, stretch by stretch."""
    counts = counts or {"sessions": F.count("*")}
    first, *_ = counts
    mark = lambda k: F.bit_xor(F.xxhash64(F.lit(k), "place", "event"))
    known = turned.groupBy(*keys).agg(F.count("*").alias("turns"), mark(1).alias("h1"), mark(2).alias("h2"))
    tops = known.groupBy("turns", "h1", "h2").agg(*[c.alias(k) for k, c in counts.items()], F.min(F.struct(*keys)).alias("one"))
    if n is not None:
        rank = F.struct((-F.col(first)).alias("s"), "turns")
        last = tops.orderBy(F.desc(first), "turns").limit(n).agg(F.max(rank).alias("last"))
        tops = tops.join(F.broadcast(last), rank <= F.col("last"))  # one row
    each = lambda x, *c: F.array_join(F.sort_array(F.collect_list(F.struct(*c)))[x], ">")
    known = [*keys, "turns", *counts]
    stretches = turned.join(tops.select("one.*", "turns", *counts), keys).groupBy(*known, F.expr(f"place div {STRETCH}").alias("part"))
    texts = stretches.agg(each("event", "place", "event").alias("text")).groupBy(*known).agg(each("text", "part", "text").alias("path"))
    shown = texts.orderBy(F.desc(first), "turns", "path")
    return (shown if n is None else shown.limit(n)).select("path", *counts)
