"""Transaction, history, taxonomy, quality, sampling and experiment queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.quantiles import percentiles
from tidemark.functions.rates import hash_unit_sql, two_sided_p_sql, with_rate
from tidemark.operators import experiment, history, sampling, sessions, taxonomy, visitors
from tidemark.plans import sql as q
from tidemark.plans.registry import query
from tidemark.sources import tables as t

_Q = "round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS p75"


def _quartiles(c: str) -> list:
    return [F.round(F.expr(f"percentile({c}, 0.5)"), 6).alias("median"), F.round(F.expr(f"percentile({c}, 0.75)"), 6).alias("p75")]


@query("purchasing_visitor_rate", "period", f"""WITH {q.EV} SELECT
    {q.rate('count(DISTINCT visitorid) FILTER (transactionid IS NOT NULL)', 'count(DISTINCT visitorid)')} FROM ev""")
def purchasing_visitor_rate(spark, d):
    v = t.events(spark, d).groupBy("visitorid").agg(F.max(F.col("transactionid").isNotNull()).alias("x"))
    return v.agg(F.count_if("x").alias("a"), F.count("*").alias("b")).select(*with_rate(F.col("a"), F.col("b")))


@query("transaction_count", "day and period", f"""WITH {q.EV} SELECT CASE WHEN grouping(d) = 1 THEN 'period' ELSE 'day' END AS grain,
    coalesce(d, min(d)) AS d, count(DISTINCT transactionid) AS transactions FROM ev WHERE transactionid IS NOT NULL GROUP BY GROUPING SETS ((d), ())""")
def transaction_count(spark, d):
    """Both grains in one pass: a transaction on two days is one of the period, which has its first day. Without transactions there is
    the period's 0."""
    bought = t.events(spark, d).where("transactionid is not null").select("d", "transactionid")
    return t.by_day_and_period(bought, F.count_distinct("transactionid").alias("transactions"))


@query("distinct_items_per_transaction", "period", f"""WITH {q.LINES}, n AS (SELECT transactionid, count(DISTINCT itemid) AS n FROM lines
    GROUP BY transactionid) SELECT count(*) AS transactions, round(avg(n), 9) AS mean, {_Q.format(c='n')} FROM n""")
def distinct_items_per_transaction(spark, d):
    n = t.lines(spark, d).groupBy("transactionid").agg(F.count_distinct("itemid").alias("n"))
    return n.agg(F.count("*").alias("transactions"), F.round(F.avg("n"), 9).alias("mean"), *_quartiles("n"))


@query("repeat_purchase_visitor_rate", "period", f"""WITH {q.ORD}, n AS (SELECT visitorid, count(DISTINCT transactionid) AS n FROM ord GROUP
    BY visitorid) SELECT {q.rate('count(*) FILTER (n >= 2)', 'count(*)')} FROM n""")
def repeat_purchase_visitor_rate(spark, d):
    n = t.orders(spark, d).groupBy("visitorid").agg(F.count_distinct("transactionid").alias("n"))
    return n.agg(F.count_if(F.col("n") >= 2).alias("a"), F.count("*").alias("b")).select(*with_rate(F.col("a"), F.col("b")))


@query("repurchase_interval_days", "period", f"""WITH {q.ORD}, g AS (SELECT (us - lag(us) OVER (PARTITION BY visitorid ORDER BY us,
    transactionid)) / 86400000000.0 AS x FROM ord) SELECT count(x) AS gaps, {_Q.format(c='x')} FROM g""")
def repurchase_interval_days(spark, d):
    found = percentiles(visitors.repurchase_gaps(t.orders(spark, d)), "gap_days", {"median": 0.5, "p75": 0.75})
    return found.select(F.col("n").alias("gaps"), F.round("median", 6).alias("median"), F.round("p75", 6).alias("p75"))


@query("repurchase_within_90_days", "period", f"""WITH {q.ORD}, f AS (SELECT visitorid, min(us) AS us FROM ord GROUP BY visitorid), top AS
    (SELECT max(us) AS last FROM ord), r AS (SELECT f.visitorid, count(ord.transactionid) AS n FROM f, top LEFT JOIN ord ON ord.visitorid =
    f.visitorid AND ord.us > f.us AND ord.us <= f.us + 90 * 86400000000
  WHERE f.us + 90 * 86400000000 <= last GROUP BY f.visitorid) SELECT {q.rate('count(*) FILTER (n > 0)', 'count(*)')} FROM r""")
def repurchase_within_90_days(spark, d):
    o = t.orders(spark, d)
    window = 90 * 86_400_000_000
    first = o.groupBy("visitorid").agg(F.min("us").alias("first"))
    r = o.join(first, "visitorid").groupBy("visitorid").agg(F.max((F.col("us") > F.col("first")) & (F.col("us") <= F.col("first") + window)).alias("again"), F.max("first").alias("first"))
    r = r.join(F.broadcast(o.agg(F.max("us").alias("last"))), F.col("first") + window <= F.col("last"))  # one row
    return r.agg(F.count_if("again").alias("a"), F.count("*").alias("b")).select(*with_rate(F.col("a"), F.col("b")))


@query("transaction_fact", "transaction", f"""WITH {q.ORD}, {q.LINES}, l AS (SELECT transactionid, count(*) AS n_lines, count(DISTINCT
    itemid) AS n_items FROM lines GROUP BY transactionid)
  SELECT transactionid, visitorid, us, n_lines, n_items FROM ord LEFT JOIN l USING (transactionid)""")
def transaction_fact(spark, d):
    l = t.lines(spark, d).groupBy("transactionid").agg(F.count("*").alias("n_lines"), F.count_distinct("itemid").alias("n_items"))  # noqa: E741
    return t.orders(spark, d).join(l, "transactionid", "left").select("transactionid", "visitorid", "us", "n_lines", "n_items")


@query("item_property_history", "item change", f"""WITH {q.CHANGES} SELECT itemid, categoryid, us AS valid_from, lead(us) OVER (PARTITION BY
    itemid ORDER BY us) AS valid_to FROM changes""")
def item_property_history(spark, d):
    return history.valid_ranges(t.category_changes(spark, d), ["itemid"]).select("itemid", "categoryid", "valid_from", "valid_to")


_ASOF = f"""WITH {q.ORD}, {q.LINES}, {q.CHANGES}, f AS (SELECT lines.transactionid, lines.itemid, ord.us FROM lines JOIN ord USING (transactionid))
  SELECT f.transactionid, f.itemid, changes.categoryid FROM f ASOF LEFT JOIN changes ON f.itemid = changes.itemid AND f.us >= changes.us"""


def _line_facts(spark: SparkSession, d: t.Place) -> DataFrame:
    return t.lines(spark, d).join(t.orders(spark, d).select("transactionid", "us"), "transactionid")


@query("as_of_union", "order line", _ASOF)
def as_of_union(spark, d):
    found = history.as_of_union(_line_facts(spark, d), t.category_changes(spark, d), "itemid", "categoryid")
    return found.select("transactionid", "itemid", "categoryid")


@query("as_of_interval", "order line", _ASOF)
def as_of_interval(spark, d):
    found = history.as_of_interval(_line_facts(spark, d), t.category_changes(spark, d), "itemid", "categoryid")
    return found.select("transactionid", "itemid", "categoryid")


@query("item_property_coverage_rate", "period", f"SELECT {q.rate('count(categoryid)', 'count(*)')} FROM ({_ASOF})")
def item_property_coverage_rate(spark, d):
    return as_of_union(spark, d).agg(F.count("categoryid").alias("a"), F.count("*").alias("b")).select(*with_rate(F.col("a"), F.col("b")))


@query("category_tree", "category", f"""WITH RECURSIVE {q.TREE}, walk AS (SELECT categoryid, 0 AS depth, categoryid AS root, CAST(categoryid
    AS VARCHAR) AS path FROM tree WHERE parentid IS NULL
  UNION ALL SELECT tree.categoryid, depth + 1, root, path || '>' || tree.categoryid FROM walk JOIN tree ON tree.parentid = walk.categoryid)
    SELECT * FROM walk""")
def category_tree(spark, d):
    return taxonomy.with_paths(t.category_tree(spark, d)).select("categoryid", "depth", "root",
        F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query("category_tree_defects", "defect", f"""WITH RECURSIVE {q.DAMAGED}, dt AS (SELECT DISTINCT * FROM tree), walk AS (SELECT categoryid
    FROM dt WHERE parentid IS NULL UNION SELECT dt.categoryid FROM walk JOIN dt ON dt.parentid = walk.categoryid),
  reach AS (SELECT categoryid, parentid AS up FROM dt WHERE parentid <> categoryid UNION SELECT reach.categoryid, dt.parentid FROM reach
    JOIN dt ON dt.categoryid = reach.up WHERE dt.parentid <> dt.categoryid)
  SELECT 'duplicate_key' AS kind, count(*) AS findings FROM (SELECT categoryid FROM tree GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT
    'self_reference', count(*) FROM tree WHERE categoryid = parentid
  UNION ALL SELECT 'missing_parent', count(*) FROM tree WHERE parentid IS NOT NULL AND parentid NOT IN (SELECT categoryid FROM tree) UNION
    ALL SELECT 'unreachable', count(*) FROM (SELECT DISTINCT categoryid FROM tree) WHERE categoryid NOT IN (SELECT categoryid FROM walk)
  UNION ALL SELECT 'cycle', count(DISTINCT a.categoryid) FROM dt a JOIN reach ON reach.categoryid = a.categoryid AND reach.up = a.categoryid""")
def category_tree_defects(spark, d):
    return taxonomy.defects(t.damaged_tree(spark, d))


@query("duplicate_lines", "order line", """SELECT l_orderkey AS transactionid, l_partkey AS itemid, count(*) AS copies FROM lineitem GROUP
    BY ALL HAVING count(*) > 1""")
def duplicate_lines(spark, d):
    return t.lines(spark, d).groupBy("transactionid", "itemid").agg(F.count("*").alias("copies")).where("copies > 1")


@query("row_counts", "table", """SELECT *, n_rows = expected AS as_expected FROM (SELECT 'events' AS table_name, count(*) AS n_rows,
    count(DISTINCT event_id) AS expected FROM events
  UNION ALL SELECT 'orders', count(*), count(DISTINCT (o_orderkey, o_custkey)) FROM orders UNION ALL SELECT 'catalogue', count(*),
    count(DISTINCT p_partkey) FROM part)""")
def row_counts(spark, d):
    """Rows of the facts against what their keys let expect; in a warehouse also those of the source files against the configuration."""
    keys = {"events": (t.events(spark, d), ["event_id"]), "orders": (t.orders(spark, d), ["transactionid", "visitorid"]),
        "catalogue": (t.catalogue(spark, d), ["itemid"])}
    parts = [df.agg(F.count("*").alias("n_rows"), F.count_distinct(*k).alias("expected")).select(F.lit(name).alias("table_name"), "n_rows",
        "expected") for name, (df, k) in keys.items()]
    if isinstance(d, t.Warehouse):
        parts.append(t.read(spark, d, "meta/source_file_manifest").select("file", "rows", "expected_rows"))
    return reduce(DataFrame.union, parts).withColumn("as_expected", F.col("n_rows") == F.col("expected"))


_COLUMNS = ("event_id", "us", "visitorid", "event", "itemid", "transactionid")


@query("null_rates", "column", f"WITH {q.EV} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {q.rate(f'count(*) FILTER ({c} IS NULL)', 'count(*)')} FROM ev" for c in _COLUMNS))
def null_rates(spark, d):
    row = t.events(spark, d).agg(F.count("*").alias("b"), *[F.count_if(F.col(c).isNull()).alias(c) for c in _COLUMNS])
    long = row.select("b", F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("a")) for c in _COLUMNS])).alias("x"))
    return long.select("x.column_name", *with_rate(F.col("x.a"), F.col("b")))


@query("quality_report", "check", f"""WITH {q.EV}, {q.ORD}, {q.LINES}
  SELECT 'exact_duplicate_events' AS check_id, coalesce(sum(n - 1), 0)::BIGINT AS findings, sum(n)::BIGINT AS checked FROM (SELECT count(*)
    AS n FROM ev GROUP BY us, visitorid, event, itemid, transactionid)
  UNION ALL SELECT 'transaction_without_id', count(*) FILTER (event = 'transaction' AND transactionid IS NULL), count(*) FROM ev
  UNION ALL SELECT 'id_without_transaction', count(*) FILTER (event <> 'transaction' AND transactionid IS NOT NULL), count(*) FROM ev
  UNION ALL SELECT 'unknown_event', count(*) FILTER (event NOT IN ('view', 'addtocart', 'transaction')), count(*) FROM ev
  UNION ALL SELECT 'item_not_in_catalogue', count(*) FILTER (p_partkey IS NULL), count(*) FROM ev LEFT JOIN part ON itemid = p_partkey
  UNION ALL SELECT 'conflicting_property_values', count(*) FILTER (n > 1), count(*) FROM (SELECT count(DISTINCT l_suppkey) AS n FROM
    lineitem GROUP BY l_partkey, l_shipdate)
  UNION ALL SELECT 'transaction_of_several_visitors', count(*) FILTER (n > 1), count(*) FROM (SELECT count(DISTINCT visitorid) AS n FROM ord
    GROUP BY transactionid)
  UNION ALL SELECT 'null_item', count(*) FILTER (itemid IS NULL), count(*) FROM ev""")
def quality_report(spark, d):
    e = t.events(spark, d)
    n = lambda x: F.count_if(F.expr(x)).alias("findings")
    all_ = F.count("*").alias("checked")
    single = {  # one pass over the events for all checks of single rows
        "transaction_without_id": "event = 'transaction' and transactionid is null",
            "id_without_transaction": "event <> 'transaction' and transactionid is not null",
        "unknown_event": "event not in ('view', 'addtocart', 'transaction')", "null_item": "itemid is null",
    }
    row = e.agg(*[F.count_if(F.expr(x)).alias(k) for k, x in single.items()], F.count("*").alias("checked"))
    parts = [row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check_id"), F.col(k).alias("findings"), "checked")
        for k in single])).alias("x")).select("x.*")]
    dup = e.groupBy("us", "visitorid", "event", "itemid", "transactionid").agg(F.count("*").alias("n"))
    parts.append(dup.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("findings"),
        F.sum("n").alias("checked")).select(F.lit("exact_duplicate_events").alias("check_id"), "findings", "checked"))
    known = t.catalogue(spark, d).withColumn("found", F.lit(1))
    parts.append(e.join(known, "itemid", "left").agg(n("found is null"), all_).select(F.lit("item_not_in_catalogue"), "findings", "checked"))
    values = t.property_log(spark, d).groupBy("itemid", "property", "us").agg(F.count_distinct("value").alias("n"))
    parts.append(values.agg(n("n > 1"), all_).select(F.lit("conflicting_property_values"), "findings", "checked"))
    owners = t.orders(spark, d).groupBy("transactionid").agg(F.count_distinct("visitorid").alias("n"))
    parts.append(owners.agg(n("n > 1"), all_).select(F.lit("transaction_of_several_visitors"), "findings", "checked"))
    return reduce(DataFrame.union, parts)


@query("property_value_counts", "value", "SELECT CAST(p_size % 2 AS VARCHAR) AS value, count(*) AS n FROM part GROUP BY 1")
def property_value_counts(spark, d):
    """The observed values of `available`."""
    return t.properties(spark, d).where("property = 'available'").groupBy("value").agg(F.count("*").alias("n"))


@query("as_of_leakage", "period", f"""WITH {q.ORD}, {q.LINES}, {q.CHANGES}, f AS (SELECT lines.itemid, ord.us FROM lines JOIN ord USING
    (transactionid)), j AS (SELECT f.us, changes.us AS valid_from FROM f ASOF LEFT JOIN changes ON f.itemid = changes.itemid AND f.us >=
    changes.us)
  SELECT count(*) FILTER (valid_from > us) AS leaks, count(valid_from) AS matched FROM j""")
def as_of_leakage(spark, d):
    changes = t.category_changes(spark, d).select("itemid", "us", F.col("us").alias("valid_from"))
    j = history.as_of_union(_line_facts(spark, d), changes, "itemid", "valid_from")
    return j.agg(F.count_if(F.col("valid_from") > F.col("us")).alias("leaks"), F.count("valid_from").alias("matched"))


#: Visitors of the journey sample, events that a visitor of the pool has, and rows of its property sample.
VISITORS, FEWEST, MOST, BUDGET = 20, 3, 200, 250


#: Minutes of the session gap of the journeys of the given tables, whose events are hours apart; a warehouse has its own.
JOURNEY_GAP = 720


def _journeys(spark: SparkSession, d: t.Place, minutes: int | None = None) -> DataFrame:
    """All events of the sampled visitors: of those who, in a session, first viewed, then first carted, then first bought.

    The pool are those with FEWEST to MOST events; where it is too small, all of them. Raises Refused where they are too few."""
    minutes = minutes or (None if isinstance(d, t.Warehouse) else JOURNEY_GAP)
    sx = t.stored(spark, d, "fct_event", minutes)
    if sx is None:
        sx = sessions.sessionize(t.events(spark, d), minutes * sessions.MINUTE)
    first = sx.groupBy("visitorid", "session_number").pivot("event", list(t.KNOWN)).agg(F.min("us")).dropna(subset=list(t.KNOWN))
    found = first.where("view < addtocart and addtocart < transaction").select("visitorid").distinct()
    sizes = sx.groupBy("visitorid").agg(F.count("*").alias("n"))
    found = sampling.pool(found.join(sizes, "visitorid"), F.col("n").between(FEWEST, MOST), VISITORS)
    return sx.join(sampling.sample(found, "visitorid", VISITORS).select("visitorid"), "visitorid", "left_semi")


_JOURNEY = f"""{q.EV}, {q.sess(720)}, f AS (SELECT visitorid, session_number, min(us) FILTER (event = 'view') AS v, min(us) FILTER (event =
    'addtocart') AS c, min(us) FILTER (event = 'transaction') AS x FROM sx GROUP BY ALL),
  cand AS (SELECT visitorid, n BETWEEN {FEWEST} AND {MOST} AS ok FROM (SELECT DISTINCT visitorid FROM f WHERE v < c AND c < x) JOIN (SELECT
    visitorid, count(*) AS n FROM sx GROUP BY visitorid) USING (visitorid)),
  pick AS (SELECT visitorid FROM cand WHERE ok OR (SELECT count(*) FILTER (ok) FROM cand) < {VISITORS} ORDER BY md5('42:' || visitorid),
    visitorid LIMIT {VISITORS}),
  j AS (SELECT * FROM sx WHERE visitorid IN (SELECT visitorid FROM pick))"""
_LABEL_SQL = "CASE event " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in t.EVENT_LABELS.items()) + " END"
_EVENT_SQL = f"""event_id, visitorid, us, event, itemid, transactionid, {_LABEL_SQL} AS event_label, transactionid IS NOT NULL AS
    has_transaction_id, session_number, event_sequence"""


def _labelled(events: DataFrame) -> DataFrame:
    """Sampled events with their label; session and sequence come from the whole history."""
    return events.select("event_id", "visitorid", "us", "event", "itemid", "transactionid",
        t.label("event", t.EVENT_LABELS).alias("event_label"), F.col("transactionid").isNotNull().alias("has_transaction_id"), "session_number",
            "event_sequence")


@query("sample_journeys", "event", f"WITH {_JOURNEY} SELECT {_EVENT_SQL} FROM j")
def sample_journeys(spark, d, minutes=None):
    return _labelled(_journeys(spark, d, minutes)).orderBy("visitorid", "us", "event_id")


@query("sample_events", "event", f"WITH {q.EV}, {q.sess(30)} SELECT {_EVENT_SQL} FROM sx ORDER BY md5('42:' || event_id), event_id LIMIT 2000")
def sample_events(spark, d):
    """In source order."""
    sx = t.stored(spark, d, "fct_event", None)
    return _labelled(sampling.sample(sessions.sessionize(t.events(spark, d)) if sx is None else sx, "event_id", 2000)).orderBy("event_id")


_MEANING_SQL = "CASE property " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in t.PROPERTY_LABELS.items()) + f" ELSE '{t.OTHER_PROPERTY}' END"


@query("sample_properties", "property", f"""WITH {_JOURNEY}, i AS (SELECT DISTINCT itemid FROM j), p AS (SELECT p_partkey AS itemid,
    unnest(['categoryid', 'available', 'p1', 'p2']) AS property, unnest([p_type, CAST(p_size % 2 AS VARCHAR), p_name, p_brand]) AS value
    FROM part WHERE p_partkey IN (SELECT itemid FROM i)),
  m AS (SELECT * FROM p WHERE property IN ('categoryid', 'available')), o AS (SELECT * FROM p WHERE property NOT IN ('categoryid',
    'available') ORDER BY md5('42:' || itemid || property || ':0'), itemid || property || ':0' LIMIT (SELECT greatest(0, {BUDGET} -
    count(*)) FROM m))
  SELECT itemid, CAST(0 AS BIGINT) AS us, property, value, {_MEANING_SQL} AS meaning, CASE property WHEN 'categoryid' THEN 0 WHEN
    'available' THEN 1 ELSE 2 END AS priority FROM (SELECT * FROM m UNION ALL SELECT * FROM o)""")
def sample_properties(spark, d, minutes=None):
    """By priority, item, property and time."""
    items = _journeys(spark, d, minutes).select("itemid").distinct()
    p = t.properties(spark, d).join(items, "itemid", "left_semi")
    p = p.withColumn("key", F.concat(F.col("itemid").cast("string"), "property", F.lit(":"), F.col("us").cast("string")))
    priority = F.when(F.col("property") == "categoryid", 0).when(F.col("property") == "available", 1).otherwise(2)
    sampled = sampling.budgeted(p, F.col("property").isin("categoryid", "available"), "key", BUDGET)
    meaning = t.label("property", t.PROPERTY_LABELS, t.OTHER_PROPERTY)
    return sampled.select("itemid", "us", "property", "value", meaning.alias("meaning"), priority.alias("priority")).orderBy("priority",
        "itemid", "property", "us", "value")


@query("category_ancestors", "category", f"""WITH RECURSIVE {_JOURNEY}, {q.CHANGES}, {q.TREE}, up AS (SELECT DISTINCT categoryid FROM changes
    WHERE itemid IN (SELECT itemid FROM j) UNION SELECT tree.parentid FROM up JOIN tree USING (categoryid) WHERE parentid IS NOT NULL)
  SELECT categoryid, parentid FROM tree WHERE categoryid IN (SELECT categoryid FROM up)""")
def category_ancestors(spark, d, minutes=None):
    """The part of the tree that the categories of the journeys' items need, in order."""
    items = _journeys(spark, d, minutes).select("itemid").distinct()
    ids = t.category_changes(spark, d).join(items, "itemid", "left_semi").select("categoryid").distinct()
    return taxonomy.ancestors(t.category_tree(spark, d), ids).orderBy("categoryid")


@query("sample_coverage", "ratio", f"""WITH {_JOURNEY}, {q.CHANGES}, {q.TREE}, i AS (SELECT DISTINCT itemid FROM j WHERE itemid IS NOT
    NULL), c AS (SELECT DISTINCT categoryid FROM changes WHERE itemid IN (SELECT itemid FROM i))
  SELECT 'item_property' AS ratio, {q.rate('(SELECT count(*) FROM (SELECT itemid FROM i INTERSECT SELECT p_partkey FROM part))', 'count(*)')} FROM i
  UNION ALL SELECT 'category_tree',
    {q.rate('(SELECT count(*) FROM (SELECT categoryid FROM c INTERSECT SELECT categoryid FROM tree))', 'count(*)')} FROM c""")
def sample_coverage(spark, d, minutes=None):
    """Of the journeys' items, those with a property; of these items' categories, those in the tree."""
    items = _journeys(spark, d, minutes).where("itemid is not null").select("itemid").distinct()
    cats = t.category_changes(spark, d).join(items, "itemid", "left_semi").where("categoryid is not null").select("categoryid").distinct()
    out = []
    for name, own, known in (("item_property", items, t.catalogue(spark, d)),
        ("category_tree", cats, t.category_tree(spark, d).select("categoryid"))):
        both = own.intersect(known).agg(F.count("*").alias("a"))
        out.append(own.agg(F.count("*").alias("b")).join(F.broadcast(both)).select(F.lit(name).alias("ratio"),
            *with_rate(F.col("a"), F.col("b"))))  # one row each
    return reduce(DataFrame.union, out)


@query("items_viewed_never_bought", "item", f"""WITH {q.EV} SELECT itemid FROM ev WHERE event = 'view' EXCEPT SELECT itemid FROM ev WHERE
    event = 'transaction'""")
def items_viewed_never_bought(spark, d):
    e = t.events(spark, d)
    return e.where("event = 'view'").select("itemid").subtract(e.where("event = 'transaction'").select("itemid"))


_u = lambda what: hash_unit_sql("id", f"{experiment.SEED}-{what}")
_SYN = f"""u AS (SELECT {_u('channel')} AS c, {_u('arm')} AS a, {_u('click')} AS k, {_u('convert')} AS v, {_u('amount')} AS m FROM (SELECT
    unnest(range((SELECT count(*) FROM customer))) AS id)),
  i AS (SELECT scenario, [{", ".join(f"'{c}'" for c in experiment.CHANNELS)}][CAST(floor(c * {len(experiment.CHANNELS)}) AS INTEGER) + 1] AS
    channel, CASE WHEN a < 0.5 THEN 'control' ELSE 'treatment' END AS arm, k < {experiment.CLICK} AS clicked,
    k < {experiment.CLICK} AND v < CAST({experiment.CONVERT} AS DOUBLE) + CASE WHEN a < 0.5 THEN CAST(0 AS DOUBLE) ELSE CAST(lift AS DOUBLE)
    END AS converted, round(m * 90 + 10, 2) AS amount, CASE WHEN k < {experiment.CLICK} THEN 0.5 ELSE 0.01 END::DOUBLE AS cost
    FROM u, (VALUES {", ".join(f"('{s}', {x})" for s, x in experiment.LIFT.items())}) l(scenario, lift))"""


@query("campaign_metrics", "channel", f"""WITH {_SYN}, s AS (SELECT scenario, channel, count(*) AS impressions, count(*) FILTER (clicked) AS
    clicks, count(*) FILTER (converted) AS conversions, round(sum(cost), 4) AS cost, round(coalesce(sum(amount) FILTER (converted), 0), 4)
    AS gmv FROM i GROUP BY scenario, channel)
  SELECT *, round(clicks / nullif(impressions, 0), 6) AS click_through_rate, round(conversions / nullif(clicks, 0), 6) AS
    conversion_per_click, round(conversions / nullif(impressions, 0), 6) AS conversion_per_impression, round(cost / nullif(conversions, 0),
    6) AS acquisition_cost, round(gmv / nullif(cost, 0), 6) AS return_on_spend, round(gmv / nullif(conversions, 0), 6) AS
    average_order_value FROM s""", origin="synthetic")
def campaign_metrics(spark, d):
    return experiment.campaign(experiment.impressions(spark, t.n_visitors(spark, d), t.seed(d)))


@query("experiment_test", "scenario", f"""WITH {_SYN}, s AS (SELECT scenario, count(*) FILTER (arm = 'control') AS n0, count(*) FILTER (arm
    = 'treatment') AS n1, count(*) FILTER (arm = 'control' AND converted) AS x0, count(*) FILTER (arm = 'treatment' AND converted) AS x1,
    count(*) FILTER (arm = 'control' AND clicked) AS g0, count(*) FILTER (arm = 'treatment' AND clicked) AS g1 FROM i GROUP BY scenario),
  r AS (SELECT *, x0 / n0 AS p0, x1 / n1 AS p1, (x0 + x1) / (n0 + n1) AS p FROM s), z AS (SELECT *, 1.959963984540054 * sqrt(p0 * (1 - p0) /
    n0 + p1 * (1 - p1) / n1) AS half, (p1 - p0) / nullif(sqrt(p * (1 - p) * (1.0 / n0 + 1.0 / n1)), 0) AS z FROM r)
  SELECT scenario, n0 AS n_control, n1 AS n_treatment, round(p0, 9) AS rate_control, round(p1, 9) AS rate_treatment, round(p1 - p0, 9) AS
    absolute_uplift, round((p1 - p0) / nullif(p0, 0), 9) AS relative_uplift, round(p1 - p0 - half, 9) AS ci_low, round(p1 - p0 + half, 9) AS
    ci_high, round(z, 6) AS z,
    round({two_sided_p_sql('z')}, 6) AS p_value, round(g0 / n0, 9) AS guardrail_control, round(g1 / n1, 9) AS guardrail_treatment FROM z""",
    origin="synthetic")
def experiment_test(spark, d):
    return experiment.two_proportions(experiment.impressions(spark, t.n_visitors(spark, d), t.seed(d)))
