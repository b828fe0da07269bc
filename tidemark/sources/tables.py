"""The model's facts: from the given tables (a folder), or from ingested source files (a Warehouse). Every query takes either.

Times are microseconds since 1970 in UTC, whatever the session's time zone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scratch import written
from tidemark.operators import history

#: Event names of the model by those of the table; others are kept as they are and count as unknown.
EVENT_NAMES = {"view": "view", "click": "addtocart", "purchase": "transaction"}
KNOWN = ("view", "addtocart", "transaction")
# Labels of events and properties.
EVENT_LABELS = {"view": "浏览", "addtocart": "加入购物车", "transaction": "交易"}
PROPERTY_LABELS, OTHER_PROPERTY = {"categoryid": "商品分类ID", "available": "是否可售：1可售，0不可售"}, "匿名属性，不作业务解释"


#: The official session gap, and the number that synthetic data follows from.
GAP_MINUTES, SEED = 30, 20260809


@dataclass(frozen=True)
class Warehouse:
    """The folder that `build` writes the facts of the source files to, and the settings that they are made with."""

    path: str
    gap_minutes: int = GAP_MINUTES
    seed: int = SEED


Place = str | Warehouse


def gap_minutes(d: Place) -> int:
    return d.gap_minutes if isinstance(d, Warehouse) else GAP_MINUTES


def seed(d: Place) -> str:
    return str(d.seed if isinstance(d, Warehouse) else SEED)


def read(spark: SparkSession, d: Place, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.path}/{name}" if isinstance(d, Warehouse) else f"{d}/{name}.parquet")


def label(of: str, labels: dict[str, str], other: str | None = None) -> Column:
    """The label of a value by a fixed map; the default, or null, for all others."""
    return F.coalesce(*[F.when(F.col(of) == k, v) for k, v in labels.items()], F.lit(other))


def micros(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def stored(spark: SparkSession, d: Place, name: str, minutes: int | None) -> DataFrame | None:
    """A fact that `build` made with this session gap (None: the warehouse's own); None where there is no such fact."""
    return read(spark, d, f"core/{name}") if isinstance(d, Warehouse) and minutes in (None, d.gap_minutes) else None


HISTORY, HISTORY_KEYS = "core/item_property_history", ["itemid", "property"]


def largest() -> Column:
    """Of several values at one time the largest holds: numbers by their size, before other texts."""
    return F.struct(F.col("value").try_cast("long").isNotNull().alias("number"), F.col("value").try_cast("long").alias("size"), "value")


def value_ranges(log: DataFrame) -> DataFrame:
    """Ranges (itemid, property, value, valid_from, valid_to) of all recorded values."""
    one = log.groupBy(*HISTORY_KEYS, "us").agg(F.max_by("value", largest()).alias("value"))
    return history.valid_ranges(one, HISTORY_KEYS)


def write_history(ranges: DataFrame, store: str, months: str = "static") -> None:
    """Ranges of values, laid out by the month that they begin in. months: `dynamic` replaces only the months that ranges has."""
    out = ranges.withColumn("month", F.date_format(F.timestamp_micros("valid_from"), "yyyy-MM"))
    out.repartition("month", "itemid").write.mode("overwrite").option("partitionOverwriteMode", months).partitionBy("month").parquet(f"{store}/{HISTORY}")


def add_changes(spark: SparkSession, w: Warehouse, changes: DataFrame) -> None:
    """Merges further changes (itemid, property, us, value) into the stored history, which marts take categories from; late ones too.
    Only months with ranges that go or come are written again; the result is that of one load of all changes."""
    stored_ranges = read(spark, w, HISTORY)
    columns = [c for c in stored_ranges.columns if c != "month"]
    gone, came = (written(df, "ranges") for df in history.merged(stored_ranges.select(*columns), changes, HISTORY_KEYS, "value", largest()))
    month = F.date_format(F.timestamp_micros("valid_from"), "yyyy-MM").alias("month")
    months = gone.select(month).unionByName(came.select(month)).distinct()
    left = stored_ranges.join(months, "month", "left_semi").select(*columns).join(gone, [*HISTORY_KEYS, "valid_from"], "left_anti")
    write_history(written(left.select(*columns).unionByName(came.select(*columns)), "ranges"), w.path, "dynamic")


def events(spark: SparkSession, d: Place) -> DataFrame:
    """event_id, us, d, visitorid, event, itemid, transactionid."""
    if isinstance(d, Warehouse):
        return read(spark, d, "core/fct_event").select("event_id", "us", "d", "visitorid", "event", "itemid", "transactionid")
    kind = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in EVENT_NAMES.items()], F.col("event_type"))
    return read(spark, d, "events").select(
        "event_id", micros(F.col("ts")).alias("us"), F.to_date(F.col("ts").cast("timestamp_ntz")).alias("d"),
            F.col("user_id").alias("visitorid"), kind.alias("event"),
        F.get_json_object("props", "$.k").try_cast("long").alias("itemid"),
            F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("transactionid"),
    )


def orders(spark: SparkSession, d: Place) -> DataFrame:
    """One row per transaction and visitor: transactionid, visitorid, us, d."""
    if isinstance(d, Warehouse):
        bought = events(spark, d).where("event = 'transaction' and transactionid is not null")
        return bought.groupBy("transactionid", "visitorid").agg(F.min("us").alias("us"), F.min("d").alias("d"))
    at = F.col("o_orderdate")
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("transactionid"), F.col("o_custkey").alias("visitorid"),
        micros(at).alias("us"), F.to_date(at.cast("timestamp_ntz")).alias("d"))


def lines(spark: SparkSession, d: Place) -> DataFrame:
    """One row per item line of a transaction: transactionid, itemid."""
    if isinstance(d, Warehouse):
        return events(spark, d).where("event = 'transaction' and transactionid is not null").select("transactionid", "itemid")
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("transactionid"), F.col("l_partkey").alias("itemid"))


def property_log(spark: SparkSession, d: Place) -> DataFrame:
    """Every recorded value: itemid, us, property, value (text). In the given tables an item's category is the number of the
    supplier that ships it, from the ship date on."""
    if isinstance(d, Warehouse):
        return read(spark, d, "stg/item_properties").select("itemid", (F.col("timestamp") * 1000).alias("us"), "property", "value")
    value = (F.col("l_suppkey") + 1000).cast("string")
    return read(spark, d, "lineitem").select(F.col("l_partkey").alias("itemid"), micros(F.col("l_shipdate")).alias("us"),
        F.lit("categoryid").alias("property"), value.alias("value"))


def category_changes(spark: SparkSession, d: Place) -> DataFrame:
    """History of the category: itemid, us, categoryid. One row per item and time; of several values at one time the largest
    number holds. A value that is no number counts as no category. A warehouse has the history stored."""
    if isinstance(d, Warehouse):
        held = read(spark, d, HISTORY).where("property = 'categoryid'")
        return held.select("itemid", F.col("valid_from").alias("us"), F.col("value").try_cast("long").alias("categoryid"))
    log = property_log(spark, d).where("property = 'categoryid'").withColumn("categoryid", F.col("value").try_cast("long"))
    return log.groupBy("itemid", "us").agg(F.max("categoryid").alias("categoryid"))


def properties(spark: SparkSession, d: Place) -> DataFrame:
    """Values of items, with their time: itemid, us, property, value."""
    if isinstance(d, Warehouse):
        return property_log(spark, d)
    stack = "stack(4, 'categoryid', p_type, 'available', cast(p_size % 2 as string), 'p1', p_name, 'p2', p_brand) as (property, value)"
    return read(spark, d, "part").selectExpr("p_partkey as itemid", "0L as us", stack)


def catalogue(spark: SparkSession, d: Place) -> DataFrame:
    """itemid of every item that has a property."""
    if isinstance(d, Warehouse):
        return property_log(spark, d).select("itemid").distinct()
    return read(spark, d, "part").select(F.col("p_partkey").alias("itemid"))


def n_visitors(spark: SparkSession, d: Place) -> int:
    """How many visitors there are; no more than that goes into synthetic data."""
    if isinstance(d, Warehouse):
        return events(spark, d).select("visitorid").distinct().count()
    return read(spark, d, "customer").count()


def category_tree(spark: SparkSession, d: Place) -> DataFrame:
    """(categoryid, parentid); of the given tables: region, nation, supplier."""
    return read(spark, d, "stg/category_tree").select("categoryid", "parentid") if isinstance(d, Warehouse) else area_tree(spark, d)


def area_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of three levels (categoryid, parentid): region, nation, supplier."""
    region = read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("categoryid"), F.lit(None).cast("long").alias("parentid"))
    nation = read(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).cast("long"), F.col("n_regionkey").cast("long"))
    supplier = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1000).cast("long"), (F.col("s_nationkey") + 100).cast("long"))
    return region.union(nation).union(supplier)


def damaged_tree(spark: SparkSession, d: Place) -> DataFrame:
    """For the structure checks: a tree over customers with every kind of defect planted by key; of source files, their own."""
    if isinstance(d, Warehouse):
        return category_tree(spark, d)
    k = F.col("c_custkey")
    parent = F.when(k < 10, F.lit(None)).when(k % 50 == 20, k).when(k % 50 == 21, k + 1).when(k % 50 == 22, k - 1).when(k % 50 == 23,
        -1).otherwise(F.floor(k / 10))
    one = read(spark, d, "customer").select(k.cast("long").alias("categoryid"), parent.cast("long").alias("parentid"))
    return one.union(one.where("categoryid % 97 = 5"))


def by_day_and_period(df: DataFrame, *what: Column) -> DataFrame:
    """grain (day or period), d (the day, or the period's first one) and the aggregates what, by grouping sets in one pass."""
    grain = F.when(F.grouping("d") == 1, "period").otherwise("day").alias("grain")
    out = df.withColumn("_day", F.col("d")).groupingSets([["d"], []], "d").agg(grain, F.min("_day").alias("_first"), *what)
    return out.withColumn("d", F.coalesce("d", "_first")).drop("_first")
