"""Active visitors: daily, rolling, new, returning; cohorts and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def visitor_days(events: DataFrame) -> DataFrame:
    """Distinct (visitorid, d): what all activity metrics start from."""
    return events.select("visitorid", "d").distinct()


def rolling_active(days: DataFrame, width: int) -> DataFrame:
    """(d, visitors, is_full_window): distinct visitors of the day and the width - 1 days before.

    Each visitor's active days become intervals [d, d + width), merged where they meet; day by day the open intervals are
    counted. So a row is made per interval, not per visitor, day and window, and the last window is over days alone."""
    visitor = Window.partitionBy("visitorid").orderBy("d")
    fresh = days.withColumn("starts", F.coalesce(F.datediff("d", F.lag("d").over(visitor)) > width, F.lit(True)).cast("int"))
    runs = fresh.withColumn("run", F.sum("starts").over(visitor)).groupBy("visitorid", "run").agg(F.min("d").alias("a"),
        F.date_add(F.max("d"), width).alias("b"))
    deltas = runs.select(F.explode(F.array(F.struct(F.col("a").alias("d"), F.lit(1).alias("x")),
        F.struct(F.col("b").alias("d"), F.lit(-1).alias("x")))).alias("e")).groupBy("e.d").agg(F.sum("e.x").alias("x"))
    ends = days.agg(F.min("d").alias("low"), F.max("d").alias("high"))
    calendar = ends.select(F.explode(F.sequence("low", "high")).alias("d"), "low")
    # one row per calendar day from here on
    open_ = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    out = calendar.join(deltas, "d", "left").select("d", "low", F.sum(F.coalesce("x", F.lit(0))).over(open_).alias("visitors"))
    return out.where("visitors > 0").select("d", F.col("visitors").cast("long").alias("visitors"),
        (F.datediff("d", "low") >= width - 1).alias("is_full_window"))


def first_days(days: DataFrame) -> DataFrame:
    return days.groupBy("visitorid").agg(F.min("d").alias("first_d"))


def retention(days: DataFrame, offsets: tuple[int, ...] = (1, 3, 7, 14, 30)) -> DataFrame:
    """One row per cohort (first day) and offset: cohort_size and retained, which is null where day first + offset lies
    beyond the data (not observable, so neither retained nor lost)."""
    firsts = first_days(days)
    last = days.agg(F.max("d").alias("last_d"))
    after = days.join(firsts, "visitorid").select("first_d", F.datediff("d", "first_d").alias("n"))
    back = after.where(F.col("n").isin(list(offsets))).groupBy("first_d", "n").agg(F.count("*").alias("retained"))
    sizes = firsts.groupBy("first_d").agg(F.count("*").alias("cohort_size"))
    grid = sizes.select("first_d", "cohort_size", F.explode(F.array(*[F.lit(n) for n in offsets])).alias("n"))
    out = grid.join(back, ["first_d", "n"], "left").join(F.broadcast(last))  # one row
    return out.select("first_d", "n", "cohort_size", F.when(F.date_add("first_d", F.col("n")) <= F.col("last_d"),
        F.coalesce("retained", F.lit(0))).cast("long").alias("retained"))


def filtered(mart: DataFrame, since=None, until=None, category=None, cohort=None, segment=None, days: DataFrame | None = None) -> DataFrame:
    """The rows of a mart with d from since to until and the category, cohort and segment named (one value or several), and, with
    days (d), on one of these days; a filter that is not given takes all. Of a mart laid out by day, bounds are partition filters
    and days prune partitions when the query runs."""
    bounds = [F.col("d") >= F.lit(since).cast("date")] * (since is not None) + [F.col("d") <= F.lit(until).cast("date")] * (until is not None)
    for name, value in (("category", category), ("cohort", cohort), ("segment", segment)):
        if value is not None:
            values = list(value) if isinstance(value, (list, tuple, set)) else [value]
            kind = mart.schema[name].dataType
            bounds.append(F.col(name).isin([F.lit(v).cast(kind) for v in values]))
    for condition in bounds:
        mart = mart.where(condition)
    return mart if days is None else mart.join(days.select("d").distinct(), "d", "left_semi")
