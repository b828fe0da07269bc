"""Operators on small fixtures with values worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions.quantiles import percentiles
from tidemark.functions.rates import two_sided_p, wilson, with_rate
from tidemark.operators import activity, experiment, funnel, history, sampling, sessions, skew, taxonomy, visitors

MIN = 60_000_000


def events(spark, rows):
    """rows: (event_id, minute, visitorid, event, itemid)."""
    day = lambda m: dt.date(2024, 1, 1) + dt.timedelta(days=int(m // 1440))
    return spark.createDataFrame([(i, int(m * MIN), day(m), v, e, item, i if e == "transaction" else None) for i, m, v, e, item in rows],
        "event_id long, us long, d date, visitorid long, event string, itemid long, transactionid long")


def test_session_boundary_is_strict(spark):
    e = events(spark, [(1, 0, 1, "view", 1), (2, 29, 1, "view", 1), (3, 59, 1, "view", 1), (4, 90, 1, "view", 1)])
    assert [r.session_number for r in sessions.sessionize(e).orderBy("event_id").collect()] == [1, 1, 1, 2]


def test_session_goes_on_over_midnight_and_sequence_is_not_reset(spark):
    e = events(spark, [(1, 1430, 1, "view", 1), (2, 1445, 1, "view", 1), (3, 3000, 1, "view", 1), (4, 3000, 1, "view", 2)])
    got = [(r.session_number, r.event_sequence) for r in sessions.sessionize(e).orderBy("event_id").collect()]
    assert got == [(1, 1), (1, 2), (2, 3), (2, 4)]


@pytest.mark.parametrize("hot_from", [None, 250, 1])
def test_sessions_equal_a_plain_window(spark, hot_from):
    rows = [(i, (i * 7919) % 20000, (i % 5) // 2, "view", 1) for i in range(600)]
    e = events(spark, rows)
    got = {r.event_id: (r.session_number, r.event_sequence) for r in sessions.sessionize(e, hot_from=hot_from).collect()}
    want = {}
    for v in range(3):
        last, n = None, 0
        for k, (i, m, *_rest) in enumerate(sorted((r for r in rows if r[2] == v), key=lambda r: (r[1], r[0])), 1):
            n += last is None or m - last > 30
            last = m
            want[i] = (n, k)
    assert got == want


def test_funnel_order_and_abandonment(spark):
    e = events(spark, [
        (1, 5, 1, "view", 1), (2, 1, 1, "addtocart", 1),  # cart before view
        (3, 1, 2, "view", 1), (4, 2, 2, "transaction", 1),  # no cart
        (5, 1, 3, "view", 1), (6, 2, 3, "addtocart", 1), (7, 3, 3, "transaction", 1), (8, 4, 3, "addtocart", 1),
        (9, 1, 4, "view", 1), (10, 1, 4, "addtocart", 1),  # same time is no order
    ])
    got = {r.metric_id: (r.numerator, r.denominator) for r in funnel.rates(funnel.steps(e, ["visitorid"])).collect()}
    assert got == {"ordered_view_to_cart_rate": (1, 4), "ordered_cart_to_purchase_rate": (1, 1), "ordered_view_to_purchase_rate": (2, 4),
        "cart_abandonment_rate": (2, 3)}


def test_funnel_of_the_same_item(spark):
    e = events(spark, [(1, 1, 1, "view", 1), (2, 2, 1, "addtocart", 2)])
    by = lambda keys: {r.metric_id: r.numerator for r in funnel.rates(funnel.steps(e, keys)).collect()}["ordered_view_to_cart_rate"]
    assert by(["visitorid"]) == 1 and by(["visitorid", "itemid"]) == 0


def test_rolling_active_and_retention(spark):
    d = lambda n: dt.date(2024, 1, n)
    days = spark.createDataFrame([(1, d(1)), (1, d(2)), (2, d(1)), (2, d(8)), (3, d(5))], "visitorid long, d date")
    got = {r.d.day: (r.visitors, r.is_full_window) for r in activity.rolling_active(days, 3).collect()}
    assert got == {1: (2, False), 2: (2, False), 3: (2, True), 4: (1, True), 5: (1, True), 6: (1, True), 7: (1, True), 8: (1, True)}
    ret = {(r.first_d.day, r.n): (r.cohort_size, r.retained) for r in activity.retention(days, (1, 7)).collect()}
    assert ret == {(1, 1): (2, 1), (1, 7): (2, 1), (5, 1): (1, 0), (5, 7): (1, None)}


def test_as_of_bounds(spark):
    changes = spark.createDataFrame([(1, 10, "a"), (1, 20, "b")], "k long, us long, v string")
    facts = spark.createDataFrame([(i, 1, t) for i, t in enumerate((5, 10, 15, 20, 25))] + [(9, 2, 15)], "id long, k long, us long")
    for join in (history.as_of_union, history.as_of_interval):
        assert {r.id: r.v for r in join(facts, changes, "k", "v").collect()} == {0: None, 1: "a", 2: "a", 3: "b", 4: "b", 9: None}
    assert [(r.valid_from, r.valid_to) for r in history.valid_ranges(changes, ["k"]).orderBy("valid_from").collect()] == [(10, 20), (20, None)]


def test_tree(spark):
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 4), (5, 6), (6, 5), (7, 99), (2, 1)], "categoryid long, parentid long")
    assert {r.categoryid: (r.depth, r.root, r.path) for r in taxonomy.with_paths(tree.distinct()).collect()} == {1: (0, 1, [1]),
        2: (1, 1, [1, 2]), 3: (2, 1, [1, 2, 3])}
    assert {r.kind: r.findings for r in taxonomy.defects(tree).collect()} == {"duplicate_key": 1, "self_reference": 1, "missing_parent": 1,
        "cycle": 2, "unreachable": 4}
    ids = spark.createDataFrame([(3,), (5,), (42,)], "categoryid long")
    assert {r.categoryid for r in taxonomy.ancestors(tree.distinct(), ids).collect()} == {1, 2, 3, 5, 6}


def test_hot_keys_are_bounded_and_may_be_null(spark, monkeypatch):
    df = spark.createDataFrame([(None,)] * 50 + [(1,)] * 30 + [(2,)] * 20 + [(k,) for k in range(10, 40)], "k long")
    found = lambda least: {r.k for r in skew.hot_keys(df, "k", least).collect()}
    assert found(20) == {None, 1, 2} and found(21) == {None, 1} and skew.hot_keys(df, "k", 51) is None and skew.hot_keys(df, "k") is None
    monkeypatch.setattr(skew, "PARTS", 2)
    assert found(1) == {None, 1}
    hot, rest = skew.apart(df, "k", skew.hot_keys(df, "k", 20))
    assert (hot.count(), rest.count()) == (80, 50)


def test_segments_cover_all_visitors(spark):
    rows = [(1, 1, 1, "view", 1), (2, 1, 2, "view", 1), (3, 100, 2, "view", 1), (4, 1, 3, "addtocart", 1), (5, 1, 4, "transaction", 1),
        (6, 1, 5, "transaction", 1), (7, 9, 5, "transaction", 1), (8, 1, 6, "error", 1)]
    got = {r.visitorid: r.segment for r in visitors.segments(visitors.profiles(sessions.sessionize(events(spark, rows)))).collect()}
    assert got == {1: "first_session_bounce", 2: "active_browser", 3: "cart_no_purchase", 4: "first_time_buyer", 5: "repeat_buyer", 6: "other"}


def test_sampling_is_exact_and_repeatable(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a, b = ({r.k for r in sampling.sample(df.repartition(n), "k", 50).collect()} for n in (1, 7))
    assert a == b and len(a) == 50
    assert sampling.budgeted(df, F.col("k") < 30, "k", 40).count() == 40 and sampling.budgeted(df, F.col("k") < 30, "k", 10).count() == 30


def test_rates(spark):
    row = spark.range(1).select(*with_rate(F.lit(1), F.lit(0))).first()
    assert row.rate is None and row.small_sample
    low, high = spark.range(1).select(*wilson(F.lit(10), F.lit(100))).first()
    assert low == pytest.approx(0.05522914, abs=1e-7) and high == pytest.approx(0.17436566, abs=1e-7)
    assert spark.range(1).select(two_sided_p(F.lit(1.959963984540054))).first()[0] == pytest.approx(0.05, abs=1e-6)


def test_empty_inputs_keep_their_schema(spark):
    e = events(spark, [])
    assert sessions.session_fact(sessions.sessionize(e)).count() == 0
    assert activity.rolling_active(activity.visitor_days(e), 7).count() == 0
    assert activity.retention(activity.visitor_days(e)).count() == 0


def test_cycles_and_what_leads_into_them(spark):
    tree = spark.createDataFrame([(1, None), (2, 3), (3, 4), (4, 2), (5, 2), (6, 6), (7, 6), (8, 1), (9, 10), (10, 9), (11, 99)],
        "categoryid long, parentid long")
    assert {r.categoryid for r in taxonomy.cycles(tree).collect()} == {2, 3, 4, 9, 10}
    assert {r.kind: r.findings for r in taxonomy.defects(tree).collect()} == {"duplicate_key": 0, "self_reference": 1, "missing_parent": 1,
        "cycle": 5, "unreachable": 9}


@pytest.mark.parametrize("hot_from", [None, 600, 1])
def test_as_of_with_a_key_of_half_of_all_rows(spark, hot_from):
    """Many days, a null key, changes to null, days without changes and a key that never changes."""
    day = history.DAY
    changes = [(1, k * day // 3 + 7, None if k % 17 == 0 else f"v{k}") for k in range(0, 300, 2)] + [(2, 5 * day, "x")]
    facts = [(i, 1 if i % 2 == 0 else (None, 2, 3)[i % 3], (i * 7919 * 1_000_003) % (110 * day)) for i in range(1500)]
    c = spark.createDataFrame(changes, "k long, us long, v string")
    f = spark.createDataFrame(facts, "id long, k long, us long")

    def brute(k, us):
        held = [(t, v) for kk, t, v in changes if kk == k and t <= us]
        return max(held)[1] if held else None

    want = {i: brute(k, us) for i, k, us in facts}
    for join in (history.as_of_union, history.as_of_interval):
        got = join(f, c, "k", "v", hot_from=hot_from)
        assert got.columns == ["id", "k", "us", "v"] and {r.id: r.v for r in got.collect()} == want and got.count() == 1500
    ranges = sorted((r.k, r.valid_from, r.valid_to) for r in history.valid_ranges(c.where("k = 1"), ["k"], hot_from=hot_from and 100).collect())
    assert [r[2] for r in ranges[:-1]] == [r[1] for r in ranges[1:]] and ranges[-1][2] is None


def test_percentiles_equal_the_built_in_ones(spark):
    rows = [(k % 3, float(k * k % 977) if k % 3 else None) for k in range(3000)] + [(7, 5.0)] + [(8, 1e12 if k == 0 else k / 7) for k in range(500)]
    df = spark.createDataFrame(rows, "g long, x double")
    which = {"a": 0.5, "b": 0.75, "c": 0.0, "d": 1.0, "e": 0.999}
    got = {r.g: tuple(r)[1:] for r in percentiles(df, "x", which, ("g",)).collect()}
    want = {r.g: tuple(r)[1:] for r in df.groupBy("g").agg(F.count("x"),
        *[F.expr(f"percentile(x, {p})").alias(k) for k, p in which.items()]).collect()}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g]) for g in want)
    one = tuple(percentiles(df, "x", which).first())
    assert one == pytest.approx(tuple(df.agg(F.count("x"), *[F.expr(f"percentile(x, {p})") for p in which.values()]).first()))
    assert tuple(percentiles(df.limit(0), "x", {"a": 0.5}).first()) == (0, None)


def test_repurchase_gaps_go_over_days(spark):
    tx = spark.createDataFrame([(i, v, m * MIN, dt.date(2024, 1, 1) + dt.timedelta(days=m // 1440)) for i, v,
        m in ((1, 1, 0), (2, 1, 720), (3, 1, 7200), (4, 2, 5), (5, 1, 7200))], "transactionid long, visitorid long, us long, d date")
    assert sorted(r.gap_days for r in visitors.repurchase_gaps(tx).collect()) == [0.0, 0.5, 4.5]


def test_abnormal_visitors_by_share(spark):
    counts = spark.range(1, 2001).select(F.col("id").alias("visitorid"), "id").withColumnRenamed("id", "n_events")
    assert sorted(r.visitorid for r in visitors.abnormal(counts).collect()) == [1999, 2000]
    assert visitors.abnormal(counts, 0.99).count() == 20


def test_a_pool_that_is_too_small(spark):
    c = spark.range(30).withColumnRenamed("id", "k")
    assert sampling.pool(c, F.col("k") < 20, 20).count() == 20 and sampling.pool(c, F.col("k") < 19, 20).count() == 30
    with pytest.raises(ValueError):
        sampling.pool(c.where("k < 19"), F.lit(True), 20)


def test_synthetic_units_hold_no_key(spark):
    rows = experiment.impressions(spark, 50).collect()
    assert len(rows) == 100 and len({r.unit for r in rows}) == 50 and {r.data_origin for r in rows} == {"synthetic"}
    assert rows == experiment.impressions(spark, 50).collect()


def test_mart_filters(spark):
    mart = spark.createDataFrame([(dt.date(2024, 1, k), "a" if k < 3 else "b", k) for k in range(1, 6)], "d date, segment string, n int")
    n = lambda **f: [r.n for r in activity.filtered(mart, **f).orderBy("n").collect()]
    assert n() == [1, 2, 3, 4, 5] and n(since="2024-01-02", until="2024-01-04") == [2, 3, 4] and n(segment="a") == [1,
        2] and n(segment=["a", "b"], since="2024-01-02") == [2, 3, 4, 5]


def test_two_proportions_of_given_outcomes(spark):
    """20 of 200 against 35 of 200, and an arm of nobody in another scenario."""
    rows = [("a", "control", k < 20, k < 60) for k in range(200)] + [("a", "treatment", k < 35, k < 58) for k in range(200)] + [("b", "control", True, True)]
    r = experiment.two_proportions(spark.createDataFrame(rows, "scenario string, arm string, converted boolean, clicked boolean")).collect()
    assert len(r) == 1 and (r[0].n_control, r[0].n_treatment, r[0].rate_control, r[0].rate_treatment) == (200, 200, 0.1, 0.175)
    half, z = 1.959963984540054 * (0.1 * 0.9 / 200 + 0.175 * 0.825 / 200) ** 0.5, 0.075 / (0.1375 * 0.8625 * 2 / 200) ** 0.5
    assert (r[0].ci_low, r[0].ci_high, r[0].z) == pytest.approx((0.075 - half, 0.075 + half, z), abs=1e-6)
    assert r[0].p_value == pytest.approx(0.0294, abs=1e-3) and (r[0].guardrail_control, r[0].guardrail_treatment) == (0.3, 0.29)
