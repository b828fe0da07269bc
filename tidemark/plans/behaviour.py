"""Activity, session, funnel, retention, visitor and category queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.quantiles import percentiles
from tidemark.functions.rates import rate, wilson, with_rate
from tidemark.operators import activity, funnel, history, sessions, taxonomy, visitors
from tidemark.plans import sql as q
from tidemark.plans.registry import query
from tidemark.sources import tables as t

DAY = 86_400_000_000
#: Minutes of the session gap that ordered_funnel_rates and main_paths compare the official one with.
WIDE_GAP = 720


def _sx(spark: SparkSession, d: t.Place, minutes: int | None = None) -> DataFrame:
    """Events with their session; by default with the place's own gap, for which a warehouse has them stored."""
    found = t.stored(spark, d, "fct_event", minutes)
    return sessions.sessionize(t.events(spark, d), (minutes or t.gap_minutes(d)) * sessions.MINUTE) if found is None else found


def _sessions(spark: SparkSession, d: t.Place, minutes: int | None = None) -> DataFrame:
    found = t.stored(spark, d, "fct_session", minutes)
    return sessions.session_fact(_sx(spark, d, minutes)) if found is None else found


def _steps(spark: SparkSession, d: t.Place, minutes: int | None = None) -> DataFrame:
    """Funnel steps of sessions."""
    found = t.stored(spark, d, "fct_session", minutes)
    return funnel.steps(_sx(spark, d, minutes), ["visitorid", "session_number"]) if found is None else found


def _quartiles(c: str) -> list:
    return [F.round(F.expr(f"percentile({c}, 0.5)"), 6).alias("median"), F.round(F.expr(f"percentile({c}, 0.75)"), 6).alias("p75")]


def _exact(df: DataFrame, n: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The same over many distinct values of x, with the number of values as n."""
    found = percentiles(df, "x", {"median": 0.5, "p75": 0.75}, by)
    return found.select(*by, F.col("n").alias(n), F.round("median", 6).alias("median"), F.round("p75", 6).alias("p75"))


_Q = "round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS p75"


@query("event_sessions", "event", f"WITH {q.EV}, {q.sess(30)} SELECT event_id, visitorid, session_number, event_sequence FROM sx")
def event_sessions(spark, d):
    return _sx(spark, d).select("event_id", "visitorid", "session_number", "event_sequence")


@query("session_fact", "session", f"""WITH {q.EV}, {q.sess(30)}, {q.FACT} SELECT visitorid, session_number, d, start_us, n_events, n_items,
    round((end_us - start_us) / 1e6, 6) AS seconds FROM s""")
def session_fact(spark, d):
    return _sessions(spark, d).select("visitorid", "session_number", "d", "start_us", "n_events", "n_items",
        F.round((F.col("end_us") - F.col("start_us")) / 1e6, 6).alias("seconds"))


@query("daily_active_visitors", "day", f"WITH {q.EV} SELECT d, count(DISTINCT visitorid) AS visitors FROM ev GROUP BY d")
def daily_active_visitors(spark, d):
    return activity.visitor_days(t.events(spark, d)).groupBy("d").agg(F.count("*").alias("visitors"))


def _rolling_sql(width: int) -> str:
    return f"""WITH {q.EV}, {q.DAYS}, cal AS (SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d, min(d) AS
    low FROM days)
      SELECT cal.d, count(DISTINCT visitorid) AS visitors, date_diff('day', any_value(low), cal.d) >= {width - 1} AS is_full_window
      FROM cal JOIN days ON days.d <= cal.d AND days.d > cal.d - {width} GROUP BY cal.d"""


@query("rolling_7d_active_visitors", "day", _rolling_sql(7))
def rolling_7d(spark, d):
    return activity.rolling_active(activity.visitor_days(t.events(spark, d)), 7)


@query("rolling_30d_active_visitors", "day", _rolling_sql(30))
def rolling_30d(spark, d):
    return activity.rolling_active(activity.visitor_days(t.events(spark, d)), 30)


@query("dau_mau_stickiness", "day", f"""WITH dau AS (WITH {q.EV} SELECT d, count(DISTINCT visitorid) AS n FROM ev GROUP BY d), mau AS
    ({_rolling_sql(30)}) SELECT d, {q.rate('n', 'visitors')}, is_full_window FROM dau JOIN mau USING (d)""")
def stickiness(spark, d):
    return daily_active_visitors(spark, d).withColumnRenamed("visitors", "n").join(rolling_30d(spark, d), "d").select("d",
        *with_rate(F.col("n"), F.col("visitors")), "is_full_window")


@query("first_observed_visitors", "day", f"WITH {q.EV}, {q.DAYS}, {q.FIRST} SELECT first_d AS d, count(*) AS visitors FROM firsts GROUP BY first_d")
def first_observed(spark, d):
    return activity.first_days(activity.visitor_days(t.events(spark, d))).groupBy(F.col("first_d").alias("d")).agg(F.count("*").alias("visitors"))


@query("returning_visitors", "day", f"""WITH {q.EV}, {q.DAYS}, {q.FIRST} SELECT d, count(*) AS visitors FROM days JOIN firsts USING
    (visitorid) WHERE first_d < d GROUP BY d""")
def returning(spark, d):
    days = activity.visitor_days(t.events(spark, d))
    return days.join(activity.first_days(days), "visitorid").where("first_d < d").groupBy("d").agg(F.count("*").alias("visitors"))


@query("session_count", "day", f"WITH {q.EV}, {q.sess(30)}, {q.FACT} SELECT d, count(*) AS sessions FROM s GROUP BY d")
def session_count(spark, d):
    return _sessions(spark, d).groupBy("d").agg(F.count("*").alias("sessions"))


@query("events_per_session", "day and period", f"""WITH {q.EV}, {q.sess(30)}, {q.FACT} SELECT CASE WHEN grouping(d) = 1 THEN 'period' ELSE
    'day' END AS grain, coalesce(d, min(d)) AS d, CAST(sum(n_events) AS BIGINT) AS events, count(*) AS sessions, round(sum(n_events) / count(*), 9) AS mean,
    {_Q.format(c='n_events')} FROM s GROUP BY GROUPING SETS ((d), ())""")
def events_per_session(spark, d):
    """Both grains in one pass; the period has its first day."""
    return t.by_day_and_period(_sessions(spark, d).select("d", "n_events"), F.sum("n_events").alias("events"), F.count("*").alias("sessions"),
        F.round(F.sum("n_events") / F.count("*"), 9).alias("mean"), *_quartiles("n_events"))


@query("items_per_session", "period", f"WITH {q.EV}, {q.sess(30)}, {q.FACT} SELECT count(*) AS sessions, {_Q.format(c='n_items')} FROM s")
def items_per_session(spark, d):
    return _sessions(spark, d).agg(F.count("*").alias("sessions"), *_quartiles("n_items"))


@query("session_duration_seconds", "period", f"""WITH {q.EV}, {q.sess(30)}, {q.FACT} SELECT count(*) AS sessions,
    {_Q.format(c='((end_us - start_us) / 1e6)')} FROM s""")
def session_duration(spark, d, minutes=None):
    return _exact(_sessions(spark, d, minutes).select(((F.col("end_us") - F.col("start_us")) / 1e6).alias("x")), "sessions")


@query("behavior_coverage_rate", "behaviour", f"""WITH {q.EV}, {q.sess(30)}, v AS (SELECT event, count(DISTINCT visitorid) AS n FROM sx
    GROUP BY event),
  u AS (SELECT event, count(*) AS n FROM (SELECT DISTINCT event, visitorid, session_number FROM sx) GROUP BY event), nv AS (SELECT
    count(DISTINCT visitorid) AS m FROM sx), nu AS (SELECT count(*) AS m FROM (SELECT DISTINCT visitorid, session_number FROM sx))
  SELECT 'visitor' AS unit, event, {q.rate('n', 'm')} FROM v, nv UNION ALL SELECT 'session', event, {q.rate('n', 'm')} FROM u, nu""")
def behavior_coverage(spark, d):
    # one shuffle to distinct (visitor, session, event); all counts are over that
    pairs = _sx(spark, d).select("visitorid", "session_number", "event").distinct()
    out = []
    for unit, keys in (("visitor", ["visitorid"]), ("session", ["visitorid", "session_number"])):
        by = pairs.select("event", *keys).distinct().groupBy("event").agg(F.count("*").alias("n"))
        total = pairs.select(*keys).distinct().agg(F.count("*").alias("m"))
        out.append(by.join(F.broadcast(total)).select(F.lit(unit).alias("unit"), "event", *with_rate(F.col("n"), F.col("m"))))  # one row
    return reduce(DataFrame.union, out)


def _funnel_sql(minutes: int) -> str:
    return f"SELECT * FROM (WITH {q.EV}, {q.sess(minutes)}, {q.steps('visitorid, session_number')} {q.rate_rows('st', f'{minutes} AS gap_minutes, ')})"


@query("ordered_funnel_rates", "rate", f"SELECT gap_minutes, metric_id, {q.rate()} FROM ({_funnel_sql(30)} UNION ALL {_funnel_sql(720)})")
def ordered_funnel_rates(spark, d):
    """At the official gap (a warehouse: its own), and at a wide one to compare with."""
    out = [funnel.rates(_steps(spark, d, m)).select(F.lit(m).alias("gap_minutes"), "metric_id",
        *with_rate(F.col("numerator"), F.col("denominator"))) for m in dict.fromkeys((t.gap_minutes(d), WIDE_GAP))]
    return reduce(DataFrame.union, out)


@query("same_item_funnel_rate", "rate", f"""SELECT metric_id, {q.rate()} FROM (WITH {q.EV}, {q.sess(30)},
    {q.steps('visitorid, session_number, itemid')} {q.rate_rows('st')})""")
def same_item_funnel(spark, d, minutes=None):
    return funnel.rates(funnel.steps(_sx(spark, d, minutes), ["visitorid", "session_number", "itemid"])).select("metric_id",
        *with_rate(F.col("numerator"), F.col("denominator")))


@query("median_step_latency", "step", f"""WITH {q.EV}, {q.sess(30)}, {q.steps('visitorid, session_number')}
  SELECT 'view_to_cart' AS step, count(fc) AS n, {_Q.format(c='((fc - tv) / 1e6)')} FROM st UNION ALL SELECT 'cart_to_purchase', count(fx),
    {_Q.format(c='((fx - fc) / 1e6)')} FROM st""")
def median_step_latency(spark, d, minutes=None):
    st = _steps(spark, d, minutes)
    gaps = st.select(F.explode(F.array(F.struct(F.lit("view_to_cart").alias("step"), ((F.col("fc") - F.col("tv")) / 1e6).alias("x")),
        F.struct(F.lit("cart_to_purchase").alias("step"), ((F.col("fx") - F.col("fc")) / 1e6).alias("x")))).alias("e")).select("e.*")
    return _exact(gaps, "n", ("step",))


def _retention_sql(days: str, offsets: str) -> str:
    return f"""grid AS (SELECT first_d, count(*) AS cohort_size FROM firsts GROUP BY first_d), off AS (SELECT unnest({offsets}) AS n), top
    AS (SELECT max(d) AS last_d FROM {days}),
      back AS (SELECT first_d, date_diff('day', first_d, d) AS n, count(*) AS retained FROM {days} JOIN firsts USING (visitorid) GROUP BY 1, 2),
      ret AS (SELECT grid.first_d, CAST(off.n AS INTEGER) AS n, cohort_size, CASE WHEN grid.first_d + CAST(off.n AS INTEGER) <= last_d THEN
    coalesce(retained, 0) END AS retained FROM grid, off, top LEFT JOIN back ON back.first_d = grid.first_d AND back.n = off.n)"""


_RET = f"WITH {q.EV}, {q.DAYS}, {q.FIRST}, {_retention_sql('days', '[1, 3, 7, 14, 30]')}"


@query("retention_by_cohort", "cohort", f"{_RET} SELECT first_d, n, cohort_size, retained, round(retained / cohort_size, 9) AS rate FROM ret")
def retention_by_cohort(spark, d):
    return activity.retention(activity.visitor_days(t.events(spark, d))).select("*",
        F.round(rate(F.col("retained"), F.col("cohort_size")), 9).alias("rate"))


@query("retention_overall", "offset", f"""{_RET} SELECT n,
    {q.rate('coalesce(sum(retained), 0)', 'coalesce(sum(cohort_size) FILTER (retained IS NOT NULL), 0)')} FROM ret GROUP BY n""")
def retention_overall(spark, d):
    r = activity.retention(activity.visitor_days(t.events(spark, d)))
    sums = r.groupBy("n").agg(F.coalesce(F.sum("retained"), F.lit(0)).alias("a"),
        F.coalesce(F.sum(F.when(F.col("retained").isNotNull(), F.col("cohort_size"))), F.lit(0)).alias("b"))
    return sums.select("n", *with_rate(F.col("a"), F.col("b")))


@query("retention_weekly_orders", "week", f"""WITH {q.ORD}, days AS (SELECT DISTINCT visitorid, d FROM ord), {q.FIRST},
    {_retention_sql('days', '[7, 30, 90]')}
  SELECT CAST(date_trunc('week', first_d) AS DATE) AS week, n,
    {q.rate('coalesce(sum(retained), 0)', 'coalesce(sum(cohort_size) FILTER (retained IS NOT NULL), 0)')} FROM ret GROUP BY 1, 2""")
def retention_weekly_orders(spark, d):
    r = activity.retention(t.orders(spark, d).select("visitorid", "d").distinct(), (7, 30, 90))
    sums = r.groupBy(F.date_trunc("week", "first_d").cast("date").alias("week"), "n").agg(F.coalesce(F.sum("retained"), F.lit(0)).alias("a"),
        F.coalesce(F.sum(F.when(F.col("retained").isNotNull(), F.col("cohort_size"))), F.lit(0)).alias("b"))
    return sums.select("week", "n", *with_rate(F.col("a"), F.col("b")))


@query("lifecycle_segments", "segment", f"""WITH {q.EV}, {q.sess(30)},
  p AS (SELECT visitorid, count(*) FILTER (event = 'view') AS n_view, count(*) FILTER (event = 'addtocart') AS n_cart, count(DISTINCT
    transactionid) AS n_tx, max(session_number) AS n_sessions FROM sx GROUP BY visitorid)
  SELECT CASE WHEN n_tx >= 2 THEN 'repeat_buyer' WHEN n_tx = 1 THEN 'first_time_buyer' WHEN n_cart > 0 THEN 'cart_no_purchase' WHEN
    n_sessions = 1 AND n_view > 0 THEN 'first_session_bounce' WHEN n_view >= 2 THEN 'active_browser' ELSE 'other' END AS segment, count(*)
    AS visitors FROM p GROUP BY 1""")
def lifecycle_segments(spark, d):
    return visitors.segments(visitors.profiles(_sx(spark, d))).groupBy("segment").agg(F.count("*").alias("visitors"))


@query("at_risk_visitors", "visitor", f"""WITH {q.EV}, {q.DAYS}, lim AS (SELECT quantile_cont(gap, 0.75) AS x FROM (SELECT date_diff('day',
    lag(d) OVER (PARTITION BY visitorid ORDER BY d), d) AS gap FROM days)),
  l AS (SELECT visitorid, max(d) AS last_d FROM days GROUP BY visitorid) SELECT visitorid, last_d, coalesce(date_diff('day', last_d, (SELECT
    max(d) FROM days)) > x, false) AS at_risk FROM l, lim""")
def at_risk_visitors(spark, d):
    days = activity.visitor_days(t.events(spark, d))
    return visitors.at_risk(days.groupBy("visitorid").agg(F.max("d").alias("last_d")), days)


@query("abnormal_visitors", "visitor", f"""WITH {q.EV}, c AS (SELECT visitorid, count(*) AS n_events FROM ev GROUP BY visitorid) SELECT
    visitorid, n_events FROM c WHERE n_events > (SELECT quantile_cont(n_events, 0.999) FROM c)""")
def abnormal_visitors(spark, d):
    return visitors.abnormal(t.events(spark, d).groupBy("visitorid").agg(F.count("*").alias("n_events")))


@query("main_paths", "path", f"""WITH {q.EV}, {q.sess(30)}, {q.sess(720, 'wx')}, e AS (SELECT false AS wide, * FROM sx UNION ALL SELECT true, *
    FROM wx), k AS (SELECT wide, visitorid, session_number, us, event_id, event, lag(event) OVER (PARTITION BY wide, visitorid, session_number
    ORDER BY us, event_id) AS prev FROM e WHERE event IN ('view', 'addtocart', 'transaction')),
  p AS (SELECT wide, visitorid, session_number, string_agg(event, '>' ORDER BY us, event_id) AS path, count(*) AS turns FROM k WHERE prev IS
    DISTINCT FROM event GROUP BY wide, visitorid, session_number)
  SELECT path, count(*) FILTER (NOT wide) AS sessions, count(*) FILTER (wide) AS wide_sessions FROM p GROUP BY path, turns ORDER BY sessions
    DESC, turns, path""")
def main_paths(spark, d, minutes=None):
    """Every path, with its sessions at the official gap (a warehouse: its own), and at a wide one to compare with."""
    at = lambda m, wide: _sx(spark, d, m).where(F.col("event").isin(*t.KNOWN)).select(F.lit(wide).alias("wide"), "visitorid",
        "session_number", "us", "event_id", "event")
    keys = ["wide", "visitorid", "session_number"]
    return funnel.main_paths(funnel.turns(at(minutes, False).union(at(WIDE_GAP, True)), keys), keys,
        counts={"sessions": F.count_if(~F.col("wide")), "wide_sessions": F.count_if("wide")})


@query("order_anomalies", "period", f"""WITH {q.EV}, {q.sess(30)}, {q.steps('visitorid, session_number')}
  SELECT count(*) AS sessions, count(*) FILTER (last_tx IS NOT NULL AND tv IS NULL) AS purchase_without_view, count(*) FILTER (last_tx IS
    NOT NULL AND tc IS NULL) AS purchase_without_cart, count(*) FILTER (tc < tv) AS cart_before_view, count(*) FILTER (last_tx <= tc) AS
    purchase_before_cart FROM st""")
def order_anomalies(spark, d, minutes=None):
    n = lambda x: F.count_if(F.expr(x))
    return _steps(spark, d, minutes).agg(
        F.count("*").alias("sessions"), n("last_tx is not null and tv is null").alias("purchase_without_view"),
        n("last_tx is not null and tc is null").alias("purchase_without_cart"), n("tc < tv").alias("cart_before_view"),
        n("last_tx <= tc").alias("purchase_before_cart"),
    )


def _category_sql(level: str, least: int, every: bool = False) -> str:
    """every: each category with a view session has its opportunity, not only those that count."""
    peer, scored = f"AS peer FROM c WHERE viewing >= {least}", f"viewing >= {least}"
    if every:
        peer, scored = f"""FILTER (viewing >= {least}) AS counting, median(CAST(converted AS DOUBLE) / viewing) AS of_all, coalesce(counting,
    of_all) AS peer FROM c WHERE viewing > 0""", "viewing > 0"
    return f"""SELECT * FROM (WITH {q.EV}, {q.sess(30)}, {q.in_category('sx')}, g AS (SELECT {level} AS category, visitorid, session_number,
    max(CASE WHEN event = 'view' THEN 1 ELSE 0 END) AS v, max(CASE WHEN event = 'transaction' THEN 1 ELSE 0 END) AS x FROM ec WHERE {level}
    IS NOT NULL GROUP BY ALL),
      c AS (SELECT category, sum(v) AS viewing, sum(x) AS transacting, sum(v * x) AS converted FROM g GROUP BY category), m AS (SELECT
    median(CAST(converted AS DOUBLE) / viewing) {peer})
      SELECT '{level}' AS level, category, CAST(viewing AS BIGINT) AS viewing, CAST(transacting AS BIGINT) AS transacting, CAST(converted AS
    BIGINT) AS converted, round(CAST(transacting AS DOUBLE) / nullif(viewing, 0), 9) AS literal_rate, viewing >= {least} AS enough,
        CASE WHEN {scored} THEN round(viewing * greatest(0, peer - CAST(converted AS DOUBLE) / viewing), 6) END AS opportunity,
        round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 9) AS low, round((p + z * z / (2 *
    n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 9) AS high
      FROM (SELECT *, CAST(converted AS DOUBLE) / nullif(viewing, 0) AS p, CAST(nullif(viewing, 0) AS DOUBLE) AS n, 1.959963984540054 AS z
    FROM c), m)"""


def _levels_sql(least: int, every: bool = False) -> str:
    return f"{_category_sql('root', least, every)} UNION ALL {_category_sql('child', least, every)}"


def _in_category(spark: SparkSession, d: t.Place, events: DataFrame) -> DataFrame:
    """events with the category that holds at their time (categoryid) and its place in the tree: root, child (of the root)."""
    held = history.as_of_union(events, t.category_changes(spark, d), "itemid", "categoryid")
    return held.join(taxonomy.with_roots(t.category_tree(spark, d)).select("categoryid", "root", "child"), "categoryid", "left")


#: Levels of the tree, and the view sessions from which a category counts.
LEVELS, LEAST = ("root", "child"), 200


def _categories(spark: SparkSession, d: t.Place, least: int = LEAST, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """Sessions by category on each level: viewing, transacting and both, against the level's median category of those that count, or
    of all that are viewed where none counts."""
    seen = lambda e: F.max((F.col("event") == e).cast("long"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.col(k).alias("category")) for k in levels])).alias("x")
    placed = _in_category(spark, d, _sx(spark, d)).where("root is not null").select(each, "visitorid", "session_number", "event")
    g = placed.groupBy("x.level", "x.category", "visitorid", "session_number").agg(seen("view").alias("v"), seen("transaction").alias("x"))
    c = g.groupBy("level", "category").agg(F.sum("v").alias("viewing"), F.sum("x").alias("transacting"),
        F.sum(F.col("v") * F.col("x")).alias("converted"))
    c = c.withColumn("enough", F.col("viewing") >= least)
    own = rate(F.col("converted"), F.col("viewing"))
    median = F.expr("coalesce(percentile(r, 0.5) filter (where enough), percentile(r, 0.5))").alias("peer")
    peer = c.where("viewing > 0").select("level", "enough", own.alias("r")).groupBy("level").agg(median)
    low, high = wilson(F.col("converted"), F.col("viewing"))
    opportunity = F.when(F.col("viewing") > 0, F.round(F.col("viewing") * F.greatest(F.lit(0.0), F.col("peer") - own), 6))
    return c.join(F.broadcast(peer), "level", "left").select(  # a row per level
        "level", "category", "viewing", "transacting", "converted", F.round(rate(F.col("transacting"), F.col("viewing")), 9).alias("literal_rate"),
        "enough", opportunity.alias("opportunity"), F.round(low, 9).alias("low"), F.round(high, 9).alias("high"),
    )


@query("category_conversion", "category", _levels_sql(200, every=True))
def category_conversion(spark, d, least=LEAST):
    return _categories(spark, d, least)


def _rank_sql(least: int) -> str:
    return f"""WITH c AS ({_levels_sql(least)}) SELECT level, category, opportunity, rank() OVER (PARTITION BY level ORDER BY opportunity
    DESC) AS place FROM c WHERE enough"""


@query("category_opportunity_rank", "category", _rank_sql(200))
def category_opportunity_rank(spark, d, least=LEAST):
    level = Window.partitionBy("level").orderBy(F.desc("opportunity"))  # one row per category of the list
    return _categories(spark, d, least).where("enough").select("level", "category", "opportunity", F.rank().over(level).cast("long").alias("place"))


@query("category_linkage_rate", "period", f"WITH {q.EV}, {q.in_category()} SELECT {q.rate('count(root)', 'count(categoryid)')} FROM ec")
def category_linkage(spark, d):
    """Of the item events that have a category at their time, those whose category is in the tree."""
    return _in_category(spark, d, t.events(spark, d)).agg(F.count("root").alias("a"),
        F.count("categoryid").alias("b")).select(*with_rate(F.col("a"), F.col("b")))


@query("category_events_with_unknown", "category", f"""WITH {q.EV}, {q.in_category()} SELECT coalesce(CAST(root AS VARCHAR), 'unknown') AS
    category, count(*) AS n_events FROM ec GROUP BY 1""")
def category_events_with_unknown(spark, d):
    return _in_category(spark, d, t.events(spark, d)).groupBy(F.coalesce(F.col("root").cast("string"),
        F.lit("unknown")).alias("category")).agg(F.count("*").alias("n_events"))


@query("daily_visitors_by_segment", "day and segment", f"""WITH {q.EV}, {q.sess(30)}, {q.DAYS}, {q.FIRST},
  p AS (SELECT visitorid, count(*) FILTER (event = 'view') AS n_view, count(*) FILTER (event = 'addtocart') AS n_cart, count(DISTINCT
    transactionid) AS n_tx, max(session_number) AS n_sessions FROM sx GROUP BY visitorid),
  g AS (SELECT visitorid, CASE WHEN n_tx >= 2 THEN 'repeat_buyer' WHEN n_tx = 1 THEN 'first_time_buyer' WHEN n_cart > 0 THEN
    'cart_no_purchase' WHEN n_sessions = 1 AND n_view > 0 THEN 'first_session_bounce' WHEN n_view >= 2 THEN 'active_browser' ELSE 'other'
    END AS segment FROM p)
  SELECT d, CAST(date_trunc('week', first_d) AS DATE) AS cohort, segment, count(*) AS visitors FROM days JOIN firsts USING (visitorid) JOIN
    g USING (visitorid) GROUP BY ALL""")
def daily_visitors_by_segment(spark, d, **wanted):
    """Active visitors by day, cohort (week of the first day) and segment; wanted: filters of operators.activity.filtered."""
    segment = visitors.segments(visitors.profiles(_sx(spark, d))).select("visitorid",
        F.date_trunc("week", "first_d").cast("date").alias("cohort"), "segment")
    days = activity.visitor_days(t.events(spark, d)).join(segment, "visitorid")
    return activity.filtered(days, **wanted).groupBy("d", "cohort", "segment").agg(F.count("*").alias("visitors"))


@query("daily_category_sessions", "day, category, cohort and segment", f"""WITH {q.EV}, {q.sess(30)}, {q.DAYS}, {q.FIRST}, {q.in_category('sx')},
  p AS (SELECT visitorid, count(*) FILTER (event = 'view') AS n_view, count(*) FILTER (event = 'addtocart') AS n_cart, count(DISTINCT
    transactionid) AS n_tx, max(session_number) AS n_sessions FROM sx GROUP BY visitorid),
  g AS (SELECT visitorid, CASE WHEN n_tx >= 2 THEN 'repeat_buyer' WHEN n_tx = 1 THEN 'first_time_buyer' WHEN n_cart > 0 THEN
    'cart_no_purchase' WHEN n_sessions = 1 AND n_view > 0 THEN 'first_session_bounce' WHEN n_view >= 2 THEN 'active_browser' ELSE 'other'
    END AS segment FROM p),
  c AS (SELECT d, level, category, visitorid, session_number, max(CASE WHEN event = 'view' THEN 1 ELSE 0 END) AS v, max(CASE WHEN event =
    'transaction' THEN 1 ELSE 0 END) AS x FROM (SELECT d, visitorid, session_number, event, unnest(['root', 'child']) AS level,
    unnest([root, child]) AS category FROM ec WHERE root IS NOT NULL) GROUP BY ALL)
  SELECT d, level, category, CAST(date_trunc('week', first_d) AS DATE) AS cohort, segment, CAST(sum(v) AS BIGINT) AS viewing, CAST(sum(x) AS
    BIGINT) AS transacting, CAST(sum(v * x) AS BIGINT) AS converted FROM c JOIN firsts USING (visitorid) JOIN g USING (visitorid) GROUP BY ALL""")
def daily_category_sessions(spark, d, **wanted):
    """Sessions by the day of their events, category on each level, cohort and segment of their visitor: what a dashboard filters by
    time, category, cohort and segment (wanted: filters of operators.activity.filtered)."""
    segment = visitors.segments(visitors.profiles(_sx(spark, d))).select("visitorid",
        F.date_trunc("week", "first_d").cast("date").alias("cohort"), "segment")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.col(k).alias("category")) for k in LEVELS])).alias("x")
    placed = _in_category(spark, d, _sx(spark, d)).where("root is not null").select("d", each, "visitorid", "session_number", "event")
    seen = lambda e: F.max((F.col("event") == e).cast("long"))
    g = placed.groupBy("d", "x.level", "x.category", "visitorid", "session_number").agg(seen("view").alias("v"), seen("transaction").alias("t"))
    out = activity.filtered(g.join(segment, "visitorid"), **wanted)
    return out.groupBy("d", "level", "category", "cohort", "segment").agg(F.sum("v").alias("viewing"), F.sum("t").alias("transacting"),
        F.sum(F.col("v") * F.col("t")).alias("converted"))


@query("purchase_last_view", "event", f"""WITH {q.EV}, v AS (SELECT visitorid, us, max(itemid) AS viewed FROM ev WHERE event = 'view' GROUP
    BY visitorid, us), x AS (SELECT event_id, visitorid, us FROM ev WHERE event = 'transaction')
  SELECT x.event_id, v.viewed FROM x ASOF LEFT JOIN v ON x.visitorid = v.visitorid AND x.us >= v.us""")
def purchase_last_view(spark, d):
    e = t.events(spark, d)
    views = e.where("event = 'view'").groupBy("visitorid", "us").agg(F.max("itemid").alias("viewed"))
    return history.as_of_union(e.where("event = 'transaction'").select("event_id", "visitorid", "us"), views, "visitorid",
        "viewed").select("event_id", "viewed")


@query("hypothesis_cart_retention", "group", f"""WITH {q.EV}, {q.sess(30)}, {q.DAYS}, {q.FIRST}, g AS (SELECT visitorid, max(CASE WHEN
    event = 'addtocart' THEN 1 ELSE 0 END) AS c, max(CASE WHEN event = 'transaction' THEN 1 ELSE 0 END) AS x, max(CASE WHEN event = 'view'
    THEN 1 ELSE 0 END) AS v FROM sx WHERE session_number = 1 GROUP BY visitorid),
  k AS (SELECT g.visitorid, CASE WHEN c = 1 AND x = 0 THEN 'cart_no_purchase' WHEN c = 0 AND x = 0 AND v = 1 THEN 'view_only' END AS kind,
    first_d FROM g JOIN firsts USING (visitorid)),
  r AS (SELECT kind, count(days.visitorid) AS a, count(*) AS b FROM k LEFT JOIN days ON days.visitorid = k.visitorid AND days.d = k.first_d
    + 7 WHERE kind IS NOT NULL AND first_d + 7 <= (SELECT max(d) FROM days) GROUP BY kind)
  SELECT kind, {q.rate('a', 'b')}, (SELECT coalesce(max(CAST(a AS DOUBLE) / b) FILTER (kind = 'cart_no_purchase') - max(CAST(a AS DOUBLE) /
    b) FILTER (kind = 'view_only') >= 0.05, false) FROM r) AS supported FROM r""")
def hypothesis_cart_retention(spark, d, minutes=None):
    sx = _sx(spark, d, minutes)
    days = activity.visitor_days(sx)
    seen = lambda e: F.max((F.col("event") == e).cast("int"))
    g = sx.where("session_number = 1").groupBy("visitorid").agg(seen("addtocart").alias("c"), seen("transaction").alias("x"), seen("view").alias("v"))
    kind = F.when(F.expr("c = 1 and x = 0"), "cart_no_purchase").when(F.expr("c = 0 and x = 0 and v = 1"), "view_only")
    k = g.join(activity.first_days(days), "visitorid").select("visitorid", kind.alias("kind"),
        F.date_add("first_d", 7).alias("d")).where("kind is not null")
    k = k.join(F.broadcast(days.agg(F.max("d").alias("last_d"))), F.col("d") <= F.col("last_d"))  # one row
    r = k.join(days.withColumn("back", F.lit(1)), ["visitorid", "d"], "left").groupBy("kind").agg(F.count("back").alias("a"), F.count("*").alias("b"))
    of = lambda name: F.max(F.when(F.col("kind") == name, F.col("a") / F.col("b")))
    verdict = r.agg(F.coalesce(of("cart_no_purchase") - of("view_only") >= 0.05, F.lit(False)).alias("supported"))
    return r.join(F.broadcast(verdict)).select("kind", *with_rate(F.col("a"), F.col("b")), "supported")  # one row


@query("hypothesis_lost_step", "step", f"""WITH {q.EV}, {q.sess(30)}, {q.steps('visitorid, session_number')}, l AS (SELECT CASE WHEN fc IS
    NULL THEN 'view_to_cart' ELSE 'cart_to_purchase' END AS step, count(*) AS a FROM st WHERE tv IS NOT NULL AND fx IS NULL GROUP BY 1)
  SELECT step, {q.rate('a', '(SELECT sum(a) FROM l)')}, (SELECT max(a) > 0.6 * sum(a) FROM l) AS supported FROM l""")
def hypothesis_lost_step(spark, d, minutes=None):
    st = _steps(spark, d, minutes).where("tv is not null and fx is null")
    lost = st.groupBy(F.when(F.col("fc").isNull(), "view_to_cart").otherwise("cart_to_purchase").alias("step")).agg(F.count("*").alias("a"))
    total = lost.agg(F.sum("a").alias("b"), (F.max("a") > 0.6 * F.sum("a")).alias("supported"))
    return lost.join(F.broadcast(total)).select("step", *with_rate(F.col("a"), F.col("b")), "supported")  # one row


def _weak_sql(least: int) -> str:
    return f"""WITH c AS ({_levels_sql(least)}), e AS (SELECT level, CAST(converted AS DOUBLE) / viewing AS r FROM c WHERE enough),
    m AS (SELECT level, median(r) AS peer FROM e GROUP BY level)
  SELECT level, count(*) AS categories, count(*) FILTER (r <= peer - 0.02) AS weak, count(*) FILTER (r <= peer - 0.02) >= 1 AS supported
    FROM e JOIN m USING (level) GROUP BY level"""


@query("hypothesis_weak_category", "level", _weak_sql(200))
def hypothesis_weak_category(spark, d, least=LEAST):
    e = _categories(spark, d, least).where("enough").select("level", (F.col("converted") / F.col("viewing")).alias("r"))
    peer = e.groupBy("level").agg(F.expr("percentile(r, 0.5)").alias("peer"))
    weak = F.count_if(F.col("r") <= F.col("peer") - 0.02)
    return e.join(F.broadcast(peer), "level").groupBy("level").agg(F.count("*").alias("categories"), weak.alias("weak"),
        (weak >= 1).alias("supported"))  # a row per level
