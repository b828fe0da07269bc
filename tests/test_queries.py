"""Every registered query against its SQL twin."""

import datetime as dt
import math
from pathlib import Path
from statistics import median

import pytest

from tidemark.plans import behaviour, commerce  # noqa: F401
from tidemark.plans.registry import REGISTRY

DATA = Path("/root/testdata/sf0.001")
#: Too few visitors for the journey sample are in the smallest tables, so these run on the next.
LARGER, OF_JOURNEYS = Path("/root/testdata/sf0.01"), {"sample_journeys", "sample_properties", "sample_coverage", "category_ancestors"}


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v if v is None or isinstance(v, (int, bool, str)) else str(v)


@pytest.mark.skipif(not DATA.exists(), reason="the given tables are not here")
@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_equals_sql(spark, name):
    import duckdb

    data = LARGER if name in OF_JOURNEYS else DATA
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df, sql = REGISTRY[name].run(spark, str(data)), con.sql(REGISTRY[name].sql)
    cols = sorted(df.columns)
    assert cols == sorted(sql.columns)
    at = [sql.columns.index(c) for c in cols]
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[k]) for k in at) for r in sql.fetchall()), key=repr)


@pytest.mark.skipif(not DATA.exists(), reason="the given tables are not here")
def test_journeys_of_too_few_visitors_are_refused(spark):
    with pytest.raises(ValueError, match="7 candidates, 20 are needed"):
        REGISTRY["sample_journeys"].run(spark, str(DATA))


#: The order that some results have, with their columns.
ORDERS = {"sample_journeys": ("visitorid", "us", "event_id"), "sample_events": ("event_id",), "category_ancestors": ("categoryid",),
    "sample_properties": ("priority", "itemid", "property", "us", "value")}


@pytest.mark.skipif(not DATA.exists(), reason="the given tables are not here")
@pytest.mark.parametrize("name", [*ORDERS, "main_paths"])
def test_ordered_results_are_in_order(spark, name):
    rows = REGISTRY[name].run(spark, str(LARGER)).collect()
    key = (lambda r: (-r.sessions, r.path.count(">"), r.path)) if name == "main_paths" else lambda r: tuple(r[c] for c in ORDERS[name])
    assert rows == sorted(rows, key=key) and len(rows) > 5


#: Queries with a session gap, or a number of view sessions, of their own: another one than the official.
VARIANTS = [(name, {"minutes": 720}, "<= 1800000000", "<= 43200000000") for name in ("session_duration_seconds", "same_item_funnel_rate",
    "median_step_latency", "main_paths", "order_anomalies", "hypothesis_cart_retention", "hypothesis_lost_step")]
VARIANTS += [(name, {"least": 20}, ">= 200", ">= 20") for name in ("category_conversion", "category_opportunity_rank", "hypothesis_weak_category")]


@pytest.mark.skipif(not DATA.exists(), reason="the given tables are not here")
@pytest.mark.parametrize("name, wanted, official, own", VARIANTS)
def test_parameters_equal_sql(spark, name, wanted, official, own):
    import duckdb

    assert official in REGISTRY[name].sql
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{LARGER}/{t}.parquet'")
    df, sql = REGISTRY[name].run(spark, str(LARGER), **wanted), con.sql(REGISTRY[name].sql.replace(official, own))
    cols = sorted(df.columns)
    at = [sql.columns.index(c) for c in cols]
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got and got == sorted((tuple(plain(r[k]) for k in at) for r in sql.fetchall()), key=repr)


@pytest.mark.skipif(not DATA.exists(), reason="the given tables are not here")
@pytest.mark.parametrize("data, counting", [(DATA, 0), (LARGER, 6)])
def test_every_viewed_category_has_its_opportunity(spark, data, counting):
    """Against the median of those of its level that count, or of all where none does."""
    rows = REGISTRY["category_conversion"].run(spark, str(data)).collect()
    assert sum(r.enough for r in rows) == counting < len(rows)
    for level in ("root", "child"):
        viewed = [r for r in rows if r.level == level and r.viewing]
        peer = median(r.converted / r.viewing for r in [r for r in viewed if r.enough] or viewed)
        assert viewed and [r.opportunity for r in viewed] == pytest.approx([r.viewing * max(0, peer - r.converted / r.viewing) for r in viewed], abs=2e-6)


def test_opportunity_of_small_categories(spark, tmp_path):
    """Child 100 counts at two view sessions, 101 and 103 do not, 102 has no view; at ten none counts."""
    when = dt.datetime(2024, 1, 1)
    tables = {
        "region": ("r_regionkey int", [(0,)]), "nation": ("n_nationkey int, n_regionkey int", [(k, 0) for k in range(4)]),
        "supplier": ("s_suppkey long, s_nationkey int", [(k, k) for k in range(4)]),
        "lineitem": ("l_partkey long, l_suppkey long, l_shipdate timestamp_ntz", [(k, k, when - dt.timedelta(days=9)) for k in range(4)]),
        "events": ("event_id long, ts timestamp_ntz, user_id long, event_type string, props string", [(k, when + dt.timedelta(minutes=k), v, e,
            f'{{"k": {i}}}') for k, (v, e, i) in enumerate([(1, "view", 0), (1, "purchase", 0), (2, "view", 0), (3, "view", 1), (4, "purchase", 2),
            (5, "view", 3)])]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    of = lambda least: {r.category: (r.viewing, r.enough, r.opportunity) for r in REGISTRY["category_conversion"].run(spark, str(tmp_path),
        least=least).where("level = 'child'").collect()}
    assert of(2) == {100: (2, True, 0.0), 101: (1, False, 0.5), 102: (0, False, None), 103: (1, False, 0.5)}
    assert of(10) == {100: (2, False, 0.0), 101: (1, False, 0.0), 102: (0, False, None), 103: (1, False, 0.0)}
