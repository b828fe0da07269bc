"""Sessions of visitors: a gap longer than the limit starts a new one.

Events are ordered by visitor, time and event_id, by a window over each visitor. A visitor with a large part of all events is no single
task: the work on hot ones is dealt by visitor and day, within a day by a window, across days by one over a row per visitor and day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.skew import by_heat

MINUTE = 60_000_000
GAP = 30 * MINUTE


def sessionize(events: DataFrame, gap_us: int = GAP, hot_from: int | None = None) -> DataFrame:
    """events (visitorid, us, event_id, d, ...) with session_number and event_sequence, both from 1 for each visitor; the
    sequence is not reset by a session. A gap of exactly gap_us stays within the session."""
    return by_heat([events], "visitorid", lambda e: _whole(e, gap_us), lambda e: _by_day(e, gap_us), hot_from)


def _whole(events: DataFrame, gap_us: int) -> DataFrame:
    visitor = Window.partitionBy("visitorid").orderBy("us", "event_id")
    opens = F.coalesce((F.col("us") - F.lag("us").over(visitor) > gap_us).cast("int"), F.lit(1))
    marked = events.withColumns({"_opens": opens, "event_sequence": F.row_number().over(visitor).cast("long")})
    return marked.withColumn("session_number", F.sum("_opens").over(visitor)).select(*events.columns, "session_number", "event_sequence")


def _by_day(events: DataFrame, gap_us: int) -> DataFrame:
    day = Window.partitionBy("visitorid", "d").orderBy("us", "event_id")
    step = F.col("us") - F.lag("us").over(day)
    marked = events.withColumn("_new", F.coalesce((step > gap_us).cast("int"), F.lit(0)))
    marked = marked.withColumns({"_run": F.sum("_new").over(day), "_seq": F.row_number().over(day)})
    days = marked.groupBy("visitorid", "d").agg(F.min("us").alias("first"), F.max("us").alias("last"), F.sum("_new").alias("more"),
        F.count("*").alias("n"))
    visitor = Window.partitionBy("visitorid").orderBy("d")
    before = visitor.rowsBetween(Window.unboundedPreceding, -1)
    opens = F.coalesce(F.col("first") - F.lag("last").over(visitor) > gap_us, F.lit(True)).cast("int")
    days = days.withColumn("opens", opens)
    days = days.select("visitorid", "d",
        (F.coalesce(F.sum(F.col("more") + F.col("opens")).over(before), F.lit(0)) + F.col("opens")).alias("_base"),
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    out = marked.join(days, ["visitorid", "d"])
    return out.withColumns({"session_number": (F.col("_base") + F.col("_run")).cast("long"),
        "event_sequence": (F.col("_before") + F.col("_seq")).cast("long")}).select(*events.columns,
        "session_number", "event_sequence")


def session_fact(events: DataFrame) -> DataFrame:
    """One row per visitor and session of sessionized events; its day is that of its start."""
    of = lambda e: F.count_if(F.col("event") == e)
    return events.groupBy("visitorid", "session_number").agg(
        F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.min("d").alias("d"), F.count("*").alias("n_events"),
            F.count_distinct("itemid").alias("n_items"),
        of("view").alias("n_view"), of("addtocart").alias("n_cart"), of("transaction").alias("n_tx"),
    )
