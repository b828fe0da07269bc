"""Operators that go in rounds or folds: percentiles by rank selection, funnels and paths by slices, trees by doubling, history by merge."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.quantiles import percentiles
from tidemark.operators import funnel, history, taxonomy

MIN = 60_000_000


def test_an_outlier_leaves_no_large_bucket(spark):
    """200,000 values and one of 1e12; values that double; many ties."""
    rows = spark.range(200_000).select(F.lit("outlier").alias("g"), (F.col("id") * 7919 % 200_003 / 7).alias("x"))
    rows = rows.unionByName(spark.createDataFrame([("outlier", 1e12)], "g string, x double"))
    rows = rows.unionByName(spark.range(100_000).select(F.lit("doubling"), F.pow(F.lit(2.0), F.col("id") % 1000 - 500) + F.col("id") / 1e9).toDF("g", "x"))
    rows = rows.unionByName(spark.range(60_000).select(F.lit("ties"), F.floor(F.sqrt(F.col("id") % 300)).cast("double")).toDF("g", "x"))
    which, about = {"a": 0.5, "b": 0.75, "c": 0.999, "d": 0.0, "e": 1.0}, {}
    got = {r.g: tuple(r)[1:] for r in percentiles(rows, "x", which, ("g",), about).collect()}
    want = {r.g: tuple(r)[1:] for r in rows.groupBy("g").agg(F.count("x"), *[F.expr(f"percentile(x, {p})") for p in which.values()]).collect()}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g], rel=1e-12) for g in want)
    assert about["largest"] <= 200


def test_percentiles_of_odd_values(spark):
    inf, nan = float("inf"), float("nan")
    of = lambda *v: tuple(percentiles(spark.createDataFrame([(x,) for x in v], "x double"), "x", {"a": 0.0, "b": 0.5, "c": 1.0}).first())
    assert of(None, 3.0) == (1, 3.0, 3.0, 3.0) and of(None) == (0, None, None, None)
    assert of(inf, -inf, 1.0) == (3, -inf, 1.0, inf)
    got = of(nan, 1.0, 2.0)
    assert got[:3] == (3, 1.0, 2.0) and got[3] != got[3]  # NaN comes last


def funnel_rows(spark, rows):
    day = lambda us: dt.date(2024, 1, 1) + dt.timedelta(days=int(us // history.DAY))
    return spark.createDataFrame([(k, us, day(us), v, e) for k, (us, v, e) in enumerate(rows)],
        "event_id long, us long, d date, visitorid long, event string")


def plain_steps(rows):
    first = lambda x: min(x, default=None)
    of = lambda e, after=None: [us for us, kind in rows if kind == e and (after is None or us > after)]
    tv, tc = first(of("view")), first(of("addtocart"))
    fc = first(of("addtocart", tv)) if tv is not None else None
    return tv, tc, max(of("addtocart"), default=None), max(of("transaction"), default=None), fc, (first(of("transaction", fc)) if fc is not None else None)


def plain_path(rows):
    out = []
    for _, _, e in rows:
        if not out or out[-1] != e:
            out.append(e)
    return out


@pytest.fixture(scope="module")
def endless(spark):
    """A session of a third of all events over twenty days, and many short ones that cross hours; equal times, events out of order."""
    rng = random.Random(9)
    kinds = ["view", "view", "addtocart", "transaction", "other"]
    rows = [(k * 20 * MIN + rng.choice([0, 0, 1]), 1, rng.choice(kinds)) for k in range(1440)]
    for v in range(2, 300):
        at, some = rng.randrange(0, 20 * history.DAY), rng.sample(kinds, rng.randint(1, 4))
        for _ in range(rng.randint(1, 18)):
            at += rng.choice([0, 1, 7, 25, 45]) * MIN
            rows.append((at, v, rng.choice(some)))
    return funnel_rows(spark, rows), rows


def test_funnel_folds_to_plain_steps(endless):
    e, rows = endless
    got = {r.visitorid: (r.tv, r.tc, r.last_tc, r.last_tx, r.fc, r.fx) for r in funnel.steps(e, ["visitorid"]).collect()}
    assert got == {v: plain_steps([(us, x) for us, w, x in rows if w == v]) for v in {w for _, w, _ in rows}}
    # what one task has to take together: the hour of a group, and a group's hours
    largest = funnel.summaries(e, ["visitorid"]).groupBy("visitorid").count().agg(F.max("count")).first()[0]
    hours = e.groupBy("visitorid", F.expr(f"us div {funnel.HOUR}")).count().agg(F.max("count")).first()[0]
    assert hours <= 18 and largest <= 480 < 1440


@pytest.mark.parametrize("n", [1, 5, 20, 500])
def test_main_paths_equal_plain_ones(endless, n):
    e, rows = endless
    counts = {}
    for v in {w for _, w, _ in rows}:
        path = plain_path(sorted((us, k, x) for k, (us, w, x) in enumerate(rows) if w == v))
        counts[">".join(path)] = counts.get(">".join(path), 0) + 1
    want = sorted(counts.items(), key=lambda x: (-x[1], x[0].count(">"), x[0]))[:n]
    assert [tuple(r) for r in funnel.main_paths(funnel.turns(e, ["visitorid"]), ["visitorid"], n).collect()] == want


def test_a_chain_and_a_cycle(spark):
    """A chain of 5,000 nodes and a cycle of 1,000 with a way of 300 into it."""
    n = spark.range(5000).select(F.col("id").alias("categoryid"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parentid"))
    ring = spark.range(1000).select(F.col("id") + 10_000, (F.col("id") + 1) % 1000 + 10_000)
    tail = spark.range(300).select(F.col("id") + 20_000, F.when(F.col("id") > 0, F.col("id") + 19_999).otherwise(10_007))
    tree = n.union(ring).union(tail)
    got = taxonomy.with_roots(tree)
    assert got.agg(F.count("*"), F.max("depth"), F.sum("depth"), F.max("root"), F.max("child")).first() == (5000, 4999, 4999 * 2500, 0, 1)
    last = taxonomy.with_paths(tree.where("categoryid < 10000")).where("categoryid = 4999").first()
    assert last.path == list(range(5000)) and last.root == 0
    assert {r.kind: r.findings for r in taxonomy.defects(tree).collect()} == {"duplicate_key": 0, "self_reference": 0, "missing_parent": 0,
        "cycle": 1000, "unreachable": 1300}
    ids = spark.createDataFrame([(777,), (20_299,), (-5,)], "categoryid long")
    assert taxonomy.ancestors(tree, ids).count() == 778 + 300 + 1000


def test_random_forests_equal_plain_walks(spark):
    rng = random.Random(4)
    for size in (0, 1, 40, 200):
        up = {k: rng.choice([None, k, -7, *range(max(0, k - 5), k), rng.randrange(size)]) for k in range(size)}
        want, ring = {}, set()
        for k in up:
            way = [k]
            while up.get(way[-1]) is not None and up[way[-1]] not in way:
                way.append(up[way[-1]])
            if way[-1] in up and up[way[-1]] is None:
                want[k] = way[::-1]
            elif way[-1] in up and up[way[-1]] == k and k != way[-1]:
                ring.add(k)
        tree = spark.createDataFrame(list(up.items()), "categoryid long, parentid long")
        assert {r.categoryid: (r.path, r.depth, r.root) for r in taxonomy.with_paths(tree).collect()} == {k: (w, len(w) - 1,
            w[0]) for k, w in want.items()}
        assert {r.categoryid: r.child for r in taxonomy.with_roots(tree).collect()} == {k: w[min(1, len(w) - 1)] for k, w in want.items()}
        assert {r.categoryid for r in taxonomy.cycles(tree).collect()} == ring


def test_a_key_of_several_parents_goes_by_the_smallest(spark):
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2), (3, 1), (4, 3), (4, None)], "categoryid long, parentid long")
    assert {r.categoryid: r.path for r in taxonomy.with_paths(tree).collect()} == {1: [1], 2: [1, 2], 3: [1, 3], 4: [4]}


def test_two_loads_equal_one(spark):
    rng = random.Random(2)
    all_ = [(rng.randrange(30), rng.randrange(5 * history.DAY), rng.choice("abc")) for _ in range(600)] + [(0, k * 1000, "hot") for k in range(400)]
    table = lambda rows: spark.createDataFrame(rows, "k long, us long, v string").groupBy("k", "us").agg(F.max("v").alias("v"))
    plain = lambda df: sorted((r.k, r.valid_from, r.v, r.valid_to) for r in df.collect())
    want = plain(history.valid_ranges(table(all_), ["k"]))
    for cut in (1, 300, 900, len(all_)):
        stored = history.valid_ranges(table(all_[:cut]), ["k"])
        gone, came = history.merged(stored, table(all_[cut - 1 :]), ["k"], "v")  # one is loaded twice
        assert plain(stored.exceptAll(gone).unionByName(came)) == want
    # a change behind all others of its key touches its open range alone
    stored = history.valid_ranges(table(all_), ["k"])
    gone, came = history.merged(stored, table([(3, 9 * history.DAY, "z")]), ["k"], "v")
    assert gone.count() == 1 and came.count() == 2
    # a late one touches the range that it falls into, however many follow; one before all others touches none
    gone, came = history.merged(stored, table([(0, 5500, "z"), (3, -1, "z"), (77, 1, "z")]), ["k"], "v")
    assert plain(gone) == [(0, 5000, "hot", 6000)]
    first = stored.where("k = 3").agg(F.min("valid_from")).first()[0]
    assert plain(came) == [(0, 5000, "hot", 5500), (0, 5500, "z", 6000), (3, -1, "z", first), (77, 1, "z", None)]


def test_all_main_paths_at_two_gaps(spark, endless, monkeypatch):
    """Every path is there, also the endless session's, with the groups of each kind that have it; texts made stretch by stretch."""
    e, rows = endless
    monkeypatch.setattr(funnel, "STRETCH", 7)
    tagged = e.withColumn("wide", F.lit(True)).union(e.where("visitorid % 2 = 0").withColumn("wide", F.lit(False)))
    counts = {}
    for v in {w for _, w, _ in rows}:
        at = counts.setdefault(">".join(plain_path(sorted((us, k, x) for k, (us, w, x) in enumerate(rows) if w == v))), [0, 0])
        at[1] += 1
        at[0] += v % 2 == 0
    want = sorted(((p, *n) for p, n in counts.items()), key=lambda x: (-x[1], x[0].count(">"), x[0]))
    keys = ["wide", "visitorid"]
    got = funnel.main_paths(funnel.turns(tagged, keys), keys, counts={"few": F.count_if(~F.col("wide")), "all": F.count_if("wide")})
    assert [tuple(r) for r in got.collect()] == want and len(want) > 100 and max(p.count(">") for p in counts) > 700


def test_main_paths_shows_every_path_of_both_gaps(spark, tmp_path):
    """Thirty visitors with a path of their own, whose events are an hour apart, so the official gap knows their first steps alone."""
    from tidemark.plans import behaviour

    kinds, t0 = ("view", "click", "purchase"), dt.datetime(2024, 1, 1)
    rows = [(v * 100 + k, t0 + dt.timedelta(hours=k), v, kinds[(v + k) % 3], '{"k": 1}') for v in range(30) for k in range(1 + v)]
    rows = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, props string")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    got = behaviour.main_paths(spark, str(tmp_path)).collect()
    names = {"view": "view", "click": "addtocart", "purchase": "transaction"}
    paths = {">".join(names[kinds[(v + k) % 3]] for k in range(1 + v)) for v in range(30)}
    assert {r.path for r in got if r.wide_sessions} == paths and len(paths) == 30
    assert {r.path: r.sessions for r in got if r.sessions} == {"view": 155, "addtocart": 155, "transaction": 155}
    assert sum(r.wide_sessions for r in got) == 30 and len(got) == len(paths | set(names.values()))
