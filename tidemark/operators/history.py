"""Histories of slowly changing values, and as-of joins.

Windows go over a key. For hot keys the work is dealt by key and day, and what holds at a day's start is carried over one row per key
and day, so a key with a large part of all rows is no single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.skew import by_heat

DAY = 86_400_000_000


def _day(at: str) -> Column:
    return F.expr(f"`{at}` div {DAY}").alias("_day")


def valid_ranges(changes: DataFrame, keys: list[str], at: str = "us", hot_from: int | None = None) -> DataFrame:
    """changes (one row per key and time) with [valid_from, valid_to); the last one stays open."""
    return by_heat([changes], keys[0], lambda c: _ranges(c, keys, at), lambda c: _ranges_by_day(c, keys, at), hot_from)


def _ranges(changes: DataFrame, keys: list[str], at: str) -> DataFrame:
    after = F.lead(at).over(Window.partitionBy(*keys).orderBy(at))
    return changes.withColumn("valid_to", after).withColumnRenamed(at, "valid_from")


def _ranges_by_day(changes: DataFrame, keys: list[str], at: str) -> DataFrame:
    dealt = changes.withColumn("_day", _day(at))
    firsts = dealt.groupBy(*keys, "_day").agg(F.min(at).alias("_first"))
    after = firsts.select(*keys, "_day", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_day")).alias("_after"))
    within = dealt.withColumn("_within", F.lead(at).over(Window.partitionBy(*keys, "_day").orderBy(at)))
    out = within.join(after, [*keys, "_day"]).withColumn("valid_to", F.coalesce("_within", "_after"))
    return out.select(*changes.columns, "valid_to").withColumnRenamed(at, "valid_from")


def merged(ranges: DataFrame, changes: DataFrame, keys: list[str], value: str, order: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """What a file of further changes (keys, us, value) does to stored ranges (keys, value, valid_from, valid_to): the ranges that
    go and those that come instead. Only ranges that a change falls into go; all others stay, those of the same key too.

    Changes may be late, repeat stored ones, or share their time with one: of several values at one time the largest (by order, if
    given) holds, as in a load of all at once."""
    key = F.struct(*keys).alias("_k")
    largest = F.max(value) if order is None else F.max_by(value, order)
    new = changes.groupBy(key, "us").agg(largest.alias(value))
    own = ranges.select(key, F.col("valid_from").alias("us"), F.struct("valid_from", "valid_to", value).alias("_r"))
    own = own.join(new.select("_k").distinct(), "_k", "left_semi")
    held = as_of_union(new, own, "_k", "_r")  # the range that each change falls into; none before a key's first
    first = own.groupBy("_k").agg(F.min("us").alias("_first"))
    hit = held.where("_r is not null").select("_k", "_r").distinct()
    log = held.select("_k", F.col("_r.valid_from").alias("_in"), "us", value).unionByName(hit.select("_k", F.col("_r.valid_from").alias("_in"),
        F.col("_r.valid_from").alias("us"), F.col(f"_r.`{value}`").alias(value)))
    log = log.groupBy("_k", "_in", "us").agg(largest.alias(value)).withColumn("_group", F.struct("_k", "_in")).drop("_k", "_in")
    cut = valid_ranges(log, ["_group"]).select(F.col("_group._k").alias("_k"), F.col("_group._in").alias("_in"), value, "valid_from", "valid_to")
    ends = hit.select("_k", F.col("_r.valid_from").alias("_in"), F.col("_r.valid_to").alias("_end"))
    within = cut.where("_in is not null").join(ends, ["_k", "_in"])
    before = cut.where("_in is null").join(first.withColumnRenamed("_first", "_end"), "_k", "left")
    came = within.unionByName(before).withColumn("valid_to", F.coalesce("valid_to", "_end"))
    gone = hit.select("_k.*", "_r.*")
    return tuple(df.select(*ranges.columns) for df in (gone, came.select("_k.*", value, "valid_from", "valid_to")))


def _at_day_start(facts: DataFrame, changes: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """(key, _day, _before): what holds at the start of each day that a key has facts or changes on, as a struct."""
    last = changes.groupBy(key, _day(at)).agg(F.max_by(F.struct(value), at).alias("_v"))
    days = facts.select(key, _day(at)).distinct().withColumn("_v", F.lit(None).cast(last.schema["_v"].dataType))
    both = days.unionByName(last).groupBy(key, "_day").agg(F.first("_v", ignorenulls=True).alias("_v"))
    before = Window.partitionBy(key).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    return both.select(key, "_day", F.last("_v", ignorenulls=True).over(before).alias("_before"))


def as_of_union(facts: DataFrame, changes: DataFrame, key: str, value: str, at: str = "us", hot_from: int | None = None) -> DataFrame:
    """facts with the value of changes that holds at their time (a change at the same time holds), null before the first
    and for a null key.

    Both sides are stacked and the last value carried forward. facts must not have the column value."""
    known = facts.where(F.col(key).isNotNull())
    found = by_heat([known, changes], key, lambda f, c: _stacked(f, c, key, value, at), lambda f, c: _stacked_by_day(f, c, key, value, at), hot_from)
    return found.unionByName(facts.where(F.col(key).isNull()).withColumn(value, F.lit(None).cast(changes.schema[value].dataType)))


def _stack(facts: DataFrame, changes: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """Facts (_side 1) and changes (_side 0) with the change's value as a struct _v, which is not null where the value is."""
    v = F.struct(value)
    held = changes.select(v.alias("_v")).schema["_v"].dataType
    left = facts.select("*", F.lit(None).cast(held).alias("_v"), F.lit(1).alias("_side"))
    blank = [F.lit(None).cast(facts.schema[c].dataType).alias(c) if c not in (key, at) else F.col(c) for c in facts.columns]
    return left.unionByName(changes.select(*blank, v.alias("_v"), F.lit(0).alias("_side")))


def _stacked(facts: DataFrame, changes: DataFrame, key: str, value: str, at: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = _stack(facts, changes, key, value, at).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    return both.withColumn(value, F.col("_v")[value]).select(*facts.columns, value)


def _stacked_by_day(known: DataFrame, changes: DataFrame, key: str, value: str, at: str) -> DataFrame:
    names = known.columns
    before = _at_day_start(known, changes, key, value, at)
    w = Window.partitionBy(key, "_day").orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    stacked = _stack(known, changes, key, value, at).withColumn("_day", _day(at))
    stacked = stacked.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    return stacked.join(before, [key, "_day"], "left").withColumn(value, F.coalesce("_v", "_before")[value]).select(*names, value)


def as_of_interval(facts: DataFrame, changes: DataFrame, key: str, value: str, at: str = "us", hot_from: int | None = None) -> DataFrame:
    """The same by an equi-join on the key with the validity interval as condition; for hot keys by key and day, and with what the
    day began with. Fits where a key (a hot one: a day of it) has few changes."""
    return by_heat([facts, changes], key, lambda f, c: _interval(f, c, key, value, at), lambda f, c: _interval_by_day(f, c, key, value, at), hot_from)


def _interval(facts: DataFrame, changes: DataFrame, key: str, value: str, at: str) -> DataFrame:
    h = _ranges(changes.select(F.col(key).alias("_k"), F.col(at).alias("_at"), F.col(value).alias("_value")), ["_k"], "_at")
    on = (F.col(key) == F.col("_k")) & (F.col(at) >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col(at) < F.col("valid_to")))
    return facts.join(h, on, "left").select(*facts.columns, F.col("_value").alias(value))


def _interval_by_day(facts: DataFrame, changes: DataFrame, key: str, value: str, at: str) -> DataFrame:
    names = facts.columns
    before = _at_day_start(facts.where(F.col(key).isNotNull()), changes, key, value, at)
    day = Window.partitionBy(key, "_day").orderBy(at)
    h = changes.withColumn("_day", _day(at)).select(key, "_day", F.struct(value).alias("_v"), F.col(at).alias("_from"),
        F.lead(at).over(day).alias("_to"))
    h = h.withColumnsRenamed({key: "_k", "_day": "_d"})
    on = (F.col(key) == F.col("_k")) & (F.col("_day") == F.col("_d")) & (F.col(at) >= F.col("_from")) & (F.col("_to").isNull() | (F.col(at) < F.col("_to")))
    found = facts.withColumn("_day", _day(at)).join(before, [key, "_day"], "left").join(h, on, "left")
    return found.withColumn(value, F.coalesce("_v", "_before")[value]).select(*names, value)
