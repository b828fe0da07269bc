"""Profiles and lifecycle segments of visitors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.quantiles import percentiles

#: Segments are exclusive, in this order; the first that holds is taken.
SEGMENTS = (
    ("repeat_buyer", "n_tx >= 2"), ("first_time_buyer", "n_tx = 1"), ("cart_no_purchase", "n_cart > 0"),
    ("first_session_bounce", "n_sessions = 1 and n_view > 0"), ("active_browser", "n_view >= 2"),
)


def profiles(sessionized: DataFrame) -> DataFrame:
    """One row per visitor: counts of events by kind, sessions, unique transactions, first and last day."""
    of = lambda e: F.count_if(F.col("event") == e)
    return sessionized.groupBy("visitorid").agg(
        F.count("*").alias("n_events"), of("view").alias("n_view"), of("addtocart").alias("n_cart"), F.count_distinct("transactionid").alias("n_tx"),
        F.max("session_number").alias("n_sessions"), F.min("d").alias("first_d"), F.max("d").alias("last_d"),
    )


def segments(profile: DataFrame) -> DataFrame:
    """profiles with segment (`other` where none holds)."""
    return profile.withColumn("segment", F.coalesce(*[F.when(F.expr(rule), name) for name, rule in SEGMENTS], F.lit("other")))


def at_risk(profile: DataFrame, days: DataFrame) -> DataFrame:
    """profiles with at_risk: absent for longer than the third quartile of all gaps between a visitor's active days."""
    w = Window.partitionBy("visitorid").orderBy("d")
    gap = days.select(F.datediff("d", F.lag("d").over(w)).alias("gap")).agg(F.expr("percentile(gap, 0.75)").alias("limit"))
    last = days.agg(F.max("d").alias("end_d"))
    return profile.join(F.broadcast(gap.join(F.broadcast(last)))).withColumn("at_risk",
        F.coalesce(F.datediff("end_d", "last_d") > F.col("limit"), F.lit(False))).drop("limit", "end_d")  # one row


def repurchase_gaps(tx: DataFrame) -> DataFrame:
    """(visitorid, gap_days) between adjacent transactions (transactionid, visitorid, us, d) of a visitor; dealt by visitor
    and day, with the day before's last one carried over a row per visitor and day."""
    day = Window.partitionBy("visitorid", "d").orderBy("us", "transactionid")
    days = tx.groupBy("visitorid", "d").agg(F.max("us").alias("_last"))
    days = days.select("visitorid", "d", F.lag("_last").over(Window.partitionBy("visitorid").orderBy("d")).alias("_before"))
    marked = tx.select("visitorid", "d", "us", F.lag("us").over(day).alias("_within")).join(days, ["visitorid", "d"])
    return marked.select("visitorid",
        ((F.col("us") - F.coalesce("_within", "_before")) / 86_400_000_000).alias("gap_days")).where("gap_days is not null")


def abnormal(counts: DataFrame, share: float = 0.999) -> DataFrame:
    """Of (visitorid, n_events), the visitors with more events than that share of all has."""
    limit = percentiles(counts, "n_events", {"limit": share})
    return counts.join(F.broadcast(limit), F.col("n_events") > F.col("limit")).select("visitorid", "n_events")  # one row
