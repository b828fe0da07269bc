"""Common table expressions of the SQL twins (DuckDB)."""

from __future__ import annotations

EV = """ev AS (SELECT event_id, epoch_us(ts) AS us, CAST(ts AS DATE) AS d, user_id AS visitorid,
  CASE event_type WHEN 'view' THEN 'view' WHEN 'click' THEN 'addtocart' WHEN 'purchase' THEN 'transaction' ELSE event_type END AS event,
  TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS itemid, CASE WHEN event_type = 'purchase' THEN event_id END AS transactionid FROM
    events)"""
DAYS = "days AS (SELECT DISTINCT visitorid, d FROM ev)"
FIRST = "firsts AS (SELECT visitorid, min(d) AS first_d FROM days GROUP BY visitorid)"
ORD = "ord AS (SELECT o_orderkey AS transactionid, o_custkey AS visitorid, epoch_us(o_orderdate) AS us, CAST(o_orderdate AS DATE) AS d FROM orders)"
LINES = "lines AS (SELECT l_orderkey AS transactionid, l_partkey AS itemid FROM lineitem)"
CHANGES = "changes AS (SELECT l_partkey AS itemid, epoch_us(l_shipdate) AS us, max(l_suppkey + 1000) AS categoryid FROM lineitem GROUP BY 1, 2)"
TREE = """tree AS (SELECT CAST(r_regionkey AS BIGINT) AS categoryid, CAST(NULL AS BIGINT) AS parentid FROM region UNION ALL
  SELECT CAST(n_nationkey + 100 AS BIGINT), CAST(n_regionkey AS BIGINT) FROM nation UNION ALL SELECT s_suppkey + 1000, CAST(s_nationkey +
    100 AS BIGINT) FROM supplier)"""
#: The root and the child of a root that each category of the tree is under (its own for those).
PATHS = """paths AS (SELECT t0.categoryid, coalesce(t2.categoryid, t1.categoryid, t0.categoryid) AS root, CASE WHEN t2.categoryid IS NULL
    THEN t0.categoryid ELSE t1.categoryid END AS child
  FROM tree t0 LEFT JOIN tree t1 ON t1.categoryid = t0.parentid LEFT JOIN tree t2 ON t2.categoryid = t1.parentid)"""


def in_category(src: str = "ev") -> str:
    """Events with the category that holds at their time, and its place in the tree."""
    return f"""{CHANGES}, {TREE}, {PATHS}, held AS (SELECT x.*, changes.categoryid FROM {src} x ASOF LEFT JOIN changes ON x.itemid =
    changes.itemid AND x.us >= changes.us),
  ec AS (SELECT held.*, paths.root, paths.child FROM held LEFT JOIN paths USING (categoryid))"""


DAMAGED = """one AS (SELECT c_custkey AS categoryid, CASE WHEN c_custkey < 10 THEN NULL WHEN c_custkey % 50 = 20 THEN c_custkey WHEN
    c_custkey % 50 = 21 THEN c_custkey + 1
  WHEN c_custkey % 50 = 22 THEN c_custkey - 1 WHEN c_custkey % 50 = 23 THEN -1 ELSE c_custkey // 10 END AS parentid FROM customer),
  tree AS (SELECT * FROM one UNION ALL SELECT * FROM one WHERE categoryid % 97 = 5)"""


def sess(minutes: int, name: str = "sx", src: str = "ev") -> str:
    """Events with session_number and event_sequence."""
    return f"""{name} AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY visitorid ORDER BY us, event_id) AS BIGINT) AS session_number,
    row_number() OVER (PARTITION BY visitorid ORDER BY us, event_id) AS event_sequence
  FROM (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY visitorid ORDER BY us, event_id) <= {minutes * 60_000_000} THEN 0 ELSE 1 END AS
    opens FROM {src}))"""


FACT = """s AS (SELECT visitorid, session_number, min(us) AS start_us, max(us) AS end_us, min(d) AS d, count(*) AS n_events, count(DISTINCT
    itemid) AS n_items,
  count(*) FILTER (event = 'view') AS n_view, count(*) FILTER (event = 'addtocart') AS n_cart, count(*) FILTER (event = 'transaction') AS
    n_tx FROM sx GROUP BY visitorid, session_number)"""


def steps(keys: str, src: str = "sx", name: str = "st") -> str:
    """The funnel times of each group, by subqueries over the definitions."""
    return f"""{name}_t AS (SELECT {keys}, min(us) FILTER (event = 'view') AS tv, min(us) FILTER (event = 'addtocart') AS tc, max(us) FILTER
    (event = 'addtocart') AS last_tc, max(us) FILTER (event = 'transaction') AS last_tx FROM {src} GROUP BY {keys}),
  {name}_c AS (SELECT {keys}, min(us) FILTER (event = 'addtocart' AND us > tv) AS fc FROM {src} JOIN {name}_t USING ({keys}) GROUP BY {keys}),
  {name}_x AS (SELECT {keys}, min(us) FILTER (event = 'transaction' AND us > fc) AS fx FROM {src} JOIN {name}_c USING ({keys}) GROUP BY {keys}),
  {name} AS (SELECT * FROM {name}_t JOIN {name}_c USING ({keys}) JOIN {name}_x USING ({keys}))"""


RATE_ROWS = {
    "ordered_view_to_cart_rate": ("last_tc > tv", "tv IS NOT NULL"), "ordered_cart_to_purchase_rate": ("last_tx > fc", "fc IS NOT NULL"),
    "ordered_view_to_purchase_rate": ("last_tx > tv", "tv IS NOT NULL"),
        "cart_abandonment_rate": ("tc IS NOT NULL AND (last_tx IS NULL OR last_tx <= tc)", "tc IS NOT NULL"),
}


def rate_rows(src: str, extra: str = "") -> str:
    return " UNION ALL ".join(f"SELECT {extra}'{m}' AS metric_id, count(*) FILTER ({a}) AS numerator, count(*) FILTER ({b}) AS denominator FROM {src}" for m, (a, b) in RATE_ROWS.items())


def rate(num: str = "numerator", den: str = "denominator", small: int = 200) -> str:
    return f"CAST({num} AS BIGINT) AS numerator, CAST({den} AS BIGINT) AS denominator, round(CAST({num} AS DOUBLE) / nullif({den}, 0), 9) AS rate, {den} < {small} AS small_sample"
