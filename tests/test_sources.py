"""Contract, manifest, sinks, configuration, command line and streams on small files."""

import datetime as dt
import hashlib
import json
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidemark import cli, config
from tidemark.sources import contract, publish, sinks
from tidemark.streaming.sessions import session_stream

EVENTS = "timestamp,visitorid,event,itemid,transactionid\n0,1,view,7,\n60000,1,addtocart,7,\n120000,1,transaction,7,9\n120000,1,transaction,7,9\n99,2,odd,8,\n"


@pytest.fixture
def raw(tmp_path):
    folder = tmp_path / "home/data/raw/extracted"
    folder.mkdir(parents=True)
    (folder / "events.csv").write_text(EVENTS)
    (folder / "item_properties_part1.csv").write_text("timestamp,itemid,property,value\n1,7,categoryid,7\n2,7,categoryid,12.5\n")
    (folder / "item_properties_part2.csv").write_text("timestamp,itemid,property,value\n3,8,790,n3\n4,7,categoryid,\n")
    (folder / "category_tree.csv").write_text("categoryid,parentid\n7,1\n1,\n")
    return folder


def test_events_have_lineage_and_flags(spark, raw):
    rows = contract.read_events(spark, str(raw)).orderBy("event_id").collect()
    assert [r.event_id for r in rows] == [1, 2, 3, 4, 5]
    assert [r.is_exact_duplicate for r in rows] == [False, False, False, True, False]
    assert [r.is_known_event for r in rows] == [True] * 4 + [False] and rows[0].transactionid is None and rows[0].source_file == "events.csv"


def test_days_are_those_of_the_zone(spark, raw):
    """At 16:00 UTC the next day has begun in Tokyo; times stay what they are."""
    (raw / "events.csv").write_text("timestamp,visitorid,event,itemid,transactionid\n57600000,1,view,7,\n50000000,1,view,7,\n")
    for zone, days in (("UTC", [1, 1]), ("Asia/Tokyo", [2, 1])):
        rows = contract.read_events(spark, str(raw), zone).orderBy("event_id").collect()
        assert [r.d.day for r in rows] == days and [r.us for r in rows] == [57_600_000_000, 50_000_000_000]


def test_properties_and_manifest(spark, raw):
    got = {r.timestamp: (r.categoryid, r.is_bad_category, r.source_file) for r in contract.read_properties(spark, str(raw)).collect()}
    assert got == {1: (7, False, "item_properties_part1.csv"), 2: (None, True, "item_properties_part1.csv"),
        3: (None, False, "item_properties_part2.csv"), 4: (None, False, "item_properties_part2.csv")}
    items = spark.createDataFrame([(8,)], "itemid long")
    assert contract.read_properties(spark, str(raw), items).count() == 1
    m = {r.file: r for r in contract.manifest(spark, str(raw), {"events.csv": 5, "category_tree.csv": 9}, "c0ffee").collect()}
    assert len(m) == 4 and m["events.csv"].rows == 5 and {r.commit for r in m.values()} == {"c0ffee"}
    assert (m["events.csv"].rows_as_expected, m["category_tree.csv"].rows_as_expected, m["item_properties_part1.csv"].rows_as_expected) == (True,
        False, None)


@pytest.mark.parametrize("end", [b"", b"\n", b"\r\n", b"\n\n"])
@pytest.mark.parametrize("mark", [b"", b"\xef\xbb\xbf"])
def test_manifest_hashes_any_bytes(spark, raw, end, mark):
    """Files of many blocks, with and without a last line end, byte order mark or valid UTF-8."""
    data = mark + b"timestamp,visitorid,event,itemid,transactionid" + b"".join(b"\r\n%d,1,view,\xff\xfe,%d" % (k, k * k) for k in range(5000)) + end
    (raw / "events.csv").write_bytes(data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        m = {r.file: r for r in contract.manifest(spark, str(raw)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert all(m[f].sha256 == hashlib.sha256((raw / f).read_bytes()).hexdigest() and m[f].bytes == (raw / f).stat().st_size
        for f in m) and len(m) == 4


def test_filtered_properties_are_checked(spark, raw):
    (raw / "item_properties_part2.csv").write_text("timestamp,itemid,property,value\n3,8,790,n3\nx,9,790,n3\n")
    one = lambda k: contract.read_properties(spark, str(raw), spark.createDataFrame([(k,)], "itemid long"))
    assert one(8).count() == 1
    with pytest.raises(Exception, match="timestamp breaks the contract: x"):
        one(9).collect()


@pytest.mark.parametrize("text", ["visitorid,timestamp,event,itemid,transactionid\n1,0,view,7,\n",
    "timestamp,visitorid,event,itemid\n0,1,view,7\n", "timestamp,visitorid,event,itemid,transactionid\n0,x,view,7,\n"])
def test_a_broken_contract_stops(spark, raw, text):
    (raw / "events.csv").write_text(text)
    with pytest.raises(contract.ContractError):
        contract.read(spark, str(raw), "events")


MARTS = ("daily_active_visitors", "retention_by_cohort", "ordered_funnel_rates", "transaction_count", "category_conversion",
    "lifecycle_segments", "repurchase_interval_days", "sample_journeys", "event_sessions")


def test_run_all_twice_gives_the_same(spark, raw, tmp_path):
    cfg = config.build({"data_home": str(tmp_path / "home/data")})
    first = cli.run("run-all", cfg, spark, MARTS[:-2])
    marts = lambda: {n: sorted(map(repr, publish.read(spark, cfg.warehouse_directory, n).collect())) for n in MARTS[:-2]}
    once = marts()
    assert cli.run("run-all", cfg, spark, MARTS[:-2])["rows"] == first["rows"] == {"events": 5, "item_properties": 4, "category_tree": 2}
    assert marts() == once and "(numerator=1, denominator=1" in str(once["ordered_funnel_rates"]).replace("metric_id='ordered_cart_to_purchase_rate', ", "(").replace("Row(((", "(").replace("((", "(")
    found = first["quality"]
    assert (found["exact_duplicate_events"], found["unknown_event"], found["transaction_without_id"], found["category_not_a_number"],
        found["tree_cycle"], found["null_transactionid"]) == (1, 1, 0, 1, 0, 3)
    assert spark.read.parquet(f"{cfg.parquet_directory}/retention_by_cohort.parquet").columns[-1] == "data_origin"
    log = spark.read.parquet(f"{cfg.warehouse_directory}/meta/pipeline_run").collect()
    assert [r.status for r in log] == ["ok", "ok"] and len({r.input_hash for r in log}) == 1 and len(log[0].input_hash) == 64
    about = json.loads(spark.read.text(f"{cfg.export_directory}/run_manifest.json").first()[0])
    assert about["command"] == "run-all" and "| rows |" in "".join(r[0] for r in spark.read.text(f"{cfg.export_directory}/summary.md").collect())
    history = spark.read.parquet(f"{cfg.warehouse_directory}/core/item_property_history").collect()
    assert len(history) == 4 and {r.segment
        for r in spark.read.parquet(f"{cfg.warehouse_directory}/core/visitor_profile").collect()} == {"first_time_buyer", "other"}
    refused = cli.run("metrics", cfg, spark, MARTS[-2:])
    assert refused["marts"] == ["event_sessions"] and "sample_journeys" in refused["refused"]
    assert set(cli.run("metrics", cfg, spark, ("sample_events", "category_ancestors"))["refused"]) == {"category_ancestors"}
    assert cli.run("export", cfg, spark)["exported"] == sorted([*MARTS[:-2], "event_sessions", "sample_events"])  # alone, after a refusal
    exported = cli.run("export", cfg, spark, ("event_sessions", "transaction_count", "sample_events", "sample_journeys"))
    assert exported["public"] == ["transaction_count"] and exported["not_published"] == ["sample_journeys"]
    sheets, about = sinks.read_sheets(spark, cfg.export_directory)
    assert [(r.event_id, r.event_label, r.has_transaction_id) for r in sheets["sample_events"].collect()] == [(1, "浏览", False),
        (2, "加入购物车", False), (3, "交易", True), (4, "交易", True), (5, None, False)]
    assert about["counts"] == {"sample_events": 5}


def written_as_source_files(spark, data, folder):
    """The given tables as the contract's files: their events, the values of their items, and their tree."""
    from tidemark.sources import tables

    folder.mkdir(parents=True)
    e = spark.read.parquet(f"{data}/events.parquet").selectExpr("(unix_micros(cast(cast(ts as timestamp_ntz) as timestamp)) div 1000) as timestamp", "event_id")
    e = e.join(tables.events(spark, data), "event_id").orderBy("event_id").select("timestamp", "visitorid", "event", "itemid", "transactionid")
    log = tables.property_log(spark, data).selectExpr("us div 1000 as timestamp", "itemid", "property", "value")
    for name, df in (("events", e), ("item_properties_part1", log.where("itemid % 2 = 0")), ("item_properties_part2", log.where("itemid % 2 = 1")),
        ("category_tree", tables.category_tree(spark, data))):
        df.select(*[F.col(c).cast("string") for c in df.columns]).toPandas().to_csv(folder / f"{name}.csv", index=False)


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    """A warehouse made from source files that hold the given events, in milliseconds, and a DuckDB connection with the same events."""
    import duckdb

    home = tmp_path_factory.mktemp("shop") / "home/data"
    written_as_source_files(spark, "/root/testdata/sf0.001", home / "raw/extracted")
    cfg = config.build({"data_home": str(home), "expected_rows": {"events.csv": 1000, "category_tree.csv": 3}})
    for step in ("ingest", "build"):
        cli.run(step, cfg, spark)
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    # the files' event_id is the row, their times are whole milliseconds, and every event has its item
    con.sql("""CREATE VIEW events AS SELECT row_number() OVER (ORDER BY event_id) AS event_id, date_trunc('millisecond', ts) AS ts, user_id,
        event_type, props FROM '/root/testdata/sf0.001/events.parquet'""")
    return cfg, con


#: What the given tables hold elsewhere than in events: orders, lines, parts and customers are tables of their own there, so the twins
#: of these marts say nothing about files.
OF_TABLES = {"as_of_interval", "as_of_leakage", "as_of_union", "campaign_metrics", "distinct_items_per_transaction", "duplicate_lines",
    "experiment_test", "item_property_coverage_rate", "property_value_counts", "quality_report", "repeat_purchase_visitor_rate",
    "repurchase_interval_days", "repurchase_within_90_days", "retention_weekly_orders", "row_counts", "transaction_fact", "category_tree_defects",
    "sample_properties", "sample_coverage", "sample_journeys", "category_ancestors"}


def test_marts_of_ingested_files_equal_their_twins(spark, shop):
    """Every mart over events, histories and trees has the values of its SQL twin; the others are made and keep their columns."""
    from tests.test_queries import plain
    from tidemark.operators.sampling import Refused
    from tidemark.plans.registry import REGISTRY

    cfg, con = shop
    w, compared = cli.warehouse(cfg), 0
    for name, query in sorted(REGISTRY.items()):
        try:
            df = query.run(spark, w)
        except Refused:
            assert name in OF_TABLES
            continue
        sql = con.sql(query.sql)
        cols = sorted(df.columns)
        assert cols == sorted(sql.columns), name
        if name in OF_TABLES:
            assert df.limit(3).collect() is not None
            continue
        at = [sql.columns.index(c) for c in cols]
        same = {c for c in cols if c in ("transactionid", "event_id")}  # a purchase's id is that of its event, which the file numbers anew
        row = lambda r, of: tuple(plain(of(r, k)) for k in range(len(cols)) if not (cols[k] in same and name != "purchase_last_view"))
        got = sorted((row(r, lambda r, k: r[cols[k]]) for r in df.collect()), key=repr)
        assert got == sorted((row(r, lambda r, k: r[at[k]]) for r in sql.fetchall()), key=repr), name
        compared += 1
    assert compared >= 38


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_sessions_need_no_shuffle_by_visitor(spark, shop):
    from tidemark.plans.registry import REGISTRY

    w = cli.warehouse(shop[0])
    for name in ("session_count", "order_anomalies", "events_per_session"):
        assert "hashpartitioning(visitorid" not in plan_of(REGISTRY[name].run(spark, w)), name
    assert "hashpartitioning(visitorid" in plan_of(REGISTRY["session_count"].run(spark, "/root/testdata/sf0.001"))


def test_the_gap_and_the_seed_act(spark, raw, tmp_path):
    """Five minutes between two views: one session at 30 minutes, two at 4."""
    from tidemark.plans.registry import REGISTRY

    (raw / "events.csv").write_text("timestamp,visitorid,event,itemid,transactionid\n0,1,view,7,\n300000,1,addtocart,7,\n")
    found = {}
    for gap, seed in ((30, 1), (4, 2)):
        cfg = config.build({"data_home": str(tmp_path / "home/data"), "session_gap_minutes": gap, "synthetic_seed": seed})
        cli.run("ingest", cfg, spark)
        cli.run("build", cfg, spark)
        done = cli.run("metrics", cfg, spark, ("session_count", "ordered_funnel_rates"))
        assert done["marts"] == ["session_count", "ordered_funnel_rates"] and not done["unchanged"]
        of = lambda name: publish.read(spark, cfg.warehouse_directory, name).collect()
        rates = {(r.gap_minutes, r.metric_id): r.numerator for r in of("ordered_funnel_rates")}
        assert {k[0] for k in rates} == {gap, 720}
        found[gap] = (of("session_count")[0].sessions, rates[gap, "ordered_view_to_cart_rate"])
        assert cli.warehouse(cfg).seed == seed
    assert found == {30: (1, 1), 4: (2, 0)}
    from tidemark.operators import experiment

    assert experiment.impressions(spark, 5, "1").collect() != experiment.impressions(spark, 5, "2").collect()
    assert REGISTRY["campaign_metrics"].run(spark, cli.warehouse(cfg)).columns


def test_expected_rows(spark, shop):
    cfg, _ = shop
    done = cli.run("validate", cfg, spark)["quality"]
    assert done["files_with_unexpected_rows"] == 1 and done["rows_category_tree.csv"] == 37 and done["rows_events.csv"] == 0
    assert spark.read.json(f"{cfg.export_directory}/quality.json").where("check_id = 'abnormal_visitors'").first().checked == 15


def test_a_killed_run_leaves_what_was_published(spark, shop, monkeypatch):
    from tidemark.plans.registry import REGISTRY, Query

    cfg, _ = shop
    names = ("daily_active_visitors", "session_count")
    assert cli.run("metrics", cfg, spark, names)["marts"] == list(names)
    before = {n: publish.read(spark, cfg.warehouse_directory, n).collect() for n in names}
    assert cli.run("metrics", cfg, spark, names)["unchanged"] == list(names)

    def killed(*_):
        raise RuntimeError("killed")

    monkeypatch.setitem(REGISTRY, "session_count", Query("session_count", killed, None, "day", "real"))
    monkeypatch.setenv("TIDEMARK_COMMIT", "another")  # all marts are to be made anew
    with pytest.raises(RuntimeError):
        cli.run("metrics", cfg, spark, names)
    assert {n: publish.read(spark, cfg.warehouse_directory, n).collect() for n in names} == before

    def wrong(*_):
        raise ValueError("a fault of the code is no refusal")

    monkeypatch.setitem(REGISTRY, "session_count", Query("session_count", wrong, None, "day", "real"))
    with pytest.raises(ValueError, match="fault"):
        cli.run("metrics", cfg, spark, names)


def test_marts_by_day_are_pruned(spark, shop):
    from tidemark.operators.activity import filtered

    cfg, _ = shop
    cli.run("metrics", cfg, spark, ("daily_category_sessions", "daily_visitors_by_segment"))
    for name in ("daily_category_sessions", "daily_visitors_by_segment"):
        mart = publish.read(spark, cfg.warehouse_directory, name)
        days = sorted(r.d for r in mart.select("d").distinct().collect())
        some = filtered(mart, since=str(days[2]), until=str(days[4]))
        plan = plan_of(some)
        assert f"(d#" in plan.split("PartitionFilters: [")[1].split("]")[0] and {r.d for r in some.select("d").distinct().collect()} == set(days[2:5])
        picked = filtered(mart, days=spark.createDataFrame([(days[1],), (days[3],)], "d date").where("d > '1970-01-01'"))
        assert "dynamicpruning" in plan_of(picked) and {r.d for r in picked.select("d").distinct().collect()} == {days[1], days[3]}
    mart = publish.read(spark, cfg.warehouse_directory, "daily_category_sessions")
    one = mart.where("viewing > 0").first()
    wanted = filtered(mart, since=str(one.d), until=str(one.d), category=one.category, cohort=str(one.cohort), segment=one.segment)
    assert [tuple(r) for r in wanted.where(F.col("level") == one.level).collect()] == [tuple(one)]


def test_later_changes_are_merged_into_the_stored_history(spark, shop):
    from tidemark.sources import tables

    cfg, _ = shop
    w = cli.warehouse(cfg)
    ranges = lambda df: sorted(map(tuple, df.select("itemid", "property", "value", "valid_from", "valid_to").collect()), key=repr)
    log = tables.property_log(spark, w)
    late = log.where("itemid % 7 = 3").limit(5).select("itemid", "property", (F.col("us") - 86_400_000_000).alias("us"), F.lit("zz").alias("value"))
    late = late.unionByName(log.where("itemid % 7 = 4").limit(5).withColumn("value", F.lit("999")))  # smaller numbers at the same time
    late = spark.createDataFrame(late.collect(), late.schema)
    of_files = lambda: {r.file for r in spark.read.parquet(f"{w.path}/{tables.HISTORY}").select(F.col("_metadata.file_path").alias(
        "file")).distinct().collect()}
    files = of_files()
    tables.add_changes(spark, w, late)
    assert len(files & of_files()) > len(files) / 2  # the other months' files stay
    both = log.unionByName(late)
    assert ranges(tables.read(spark, w, tables.HISTORY)) == ranges(tables.value_ranges(both))
    got = {(r.itemid, r.us): r.categoryid for r in tables.category_changes(spark, w).collect()}
    want = both.where("property = 'categoryid'").groupBy("itemid", "us").agg(F.max(F.col("value").try_cast("long")).alias("c")).collect()
    assert got == {(r.itemid, r.us): r.c for r in want} and None in got.values()


BROKEN = [("1200000,1,transaction,7", "cells"), ("1260000,1,view,7,,JUNK", "cells"), ('1260000,1,"view,7,', "cells"), ("1260000,1,vi,ew,7,", "cells"),
    ('1260000,1,vi"ew,7,', "quote"), ("x,1,view,7,", "type"), ("12.5,1,view,7,", "type"), (",1,view,7,", "empty"), ("1,1,view,,", "empty")]


def test_broken_rows_stop_the_build_and_are_listed(spark, raw, tmp_path):
    """Short, long and badly quoted rows, and cells of a wrong type, among rows of several blocks."""
    good = "".join(f"{k},1,view,{k},\n" for k in range(3000))
    (raw / "events.csv").write_text("timestamp,visitorid,event,itemid,transactionid\n" + good + "".join(line + "\n" for line, _ in BROKEN) + good)
    cfg = config.build({"data_home": str(tmp_path / "home/data")})
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        with pytest.raises(contract.ContractError, match="4 x cells.*2 x empty|2 x empty.*4 x cells|4 x cells"):
            cli.run("ingest", cfg, spark)
        assert contract.differences(contract.scan(spark, str(raw), "events"), "events").count() == len(BROKEN)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    found = spark.read.parquet(f"{cfg.warehouse_directory}/meta/contract_diff").orderBy("row").collect()
    assert [(r.row, r.problem) for r in found] == [(3001 + k, p) for k, (_, p) in enumerate(BROKEN)]
    assert [r.line for r in found][:4] == [line for line, _ in BROKEN][:4] and {r.source_file for r in found} == {"events.csv"}
    assert [r.column for r in found][4:] == ["event", "timestamp", "timestamp", "timestamp", "itemid"]
    with pytest.raises(AnalysisException):
        spark.read.parquet(f"{cfg.warehouse_directory}/stg/events")
    for line, _ in BROKEN:
        (raw / "events.csv").write_text("timestamp,visitorid,event,itemid,transactionid\n" + line + "\n")
        with pytest.raises(contract.ContractError):
            contract.read_events(spark, str(raw))


def test_lines_of_the_manifest_are_not_shuffled(spark, raw):
    plan = plan_of(contract.hashed_lines(spark, [str(raw / "events.csv"), str(raw / "category_tree.csv")]))
    assert "Exchange" not in plan and "Sort" not in plan


def test_categories_are_those_of_the_event(spark, tmp_path):
    """Two items that change their category; one value that the tree lacks; one that is no number."""
    folder = tmp_path / "home/data/raw/extracted"
    folder.mkdir(parents=True)
    (folder / "events.csv").write_text("timestamp,visitorid,event,itemid,transactionid\n" + "".join(f"{t},{v},{e},{i},{x}\n" for t, v, e, i, x in (
        (10, 1, "view", 7, ""), (30, 1, "transaction", 7, 1), (50, 2, "view", 7, ""), (70, 3, "view", 8, ""), (5, 4, "view", 7, ""),
            (90, 5, "view", 9, ""), (95, 6, "view", 7, ""))))
    (folder / "item_properties_part1.csv").write_text("timestamp,itemid,property,value\n10,7,categoryid,20\n40,7,categoryid,30\n95,7,categoryid,n5\n")
    (folder / "item_properties_part2.csv").write_text("timestamp,itemid,property,value\n60,8,categoryid,99\n1,8,categoryid,20\n")
    (folder / "category_tree.csv").write_text("categoryid,parentid\n1,\n2,1\n20,2\n30,1\n")
    from tidemark.plans.registry import REGISTRY
    from tidemark.sources.tables import Warehouse

    cfg = config.build({"data_home": str(tmp_path / "home/data")})
    for step in ("ingest", "build"):
        cli.run(step, cfg, spark)
    w = Warehouse(cfg.warehouse_directory)
    # 10 and 30 in 20 (below 2), 50 in 30 itself, 70 in 99 (not in the tree), 5 and 90 in none, 95 in none that is a number
    assert [tuple(r)[:2] for r in REGISTRY["category_linkage_rate"].run(spark, w).collect()] == [(3, 4)]
    got = {(r.level, r.category): (r.viewing, r.transacting, r.converted) for r in REGISTRY["category_conversion"].run(spark, w).collect()}
    assert got == {("root", 1): (2, 1, 1), ("child", 2): (1, 1, 1), ("child", 30): (1, 0, 0)}
    assert {r.category: r.n_events for r in REGISTRY["category_events_with_unknown"].run(spark, w).collect()} == {"1": 3, "unknown": 4}


def test_a_failed_run_is_logged(spark, raw, tmp_path):
    (raw / "events.csv").write_text("nothing\n")
    cfg = config.build({"data_home": str(tmp_path / "home/data")})
    with pytest.raises(contract.ContractError):
        cli.run("ingest", cfg, spark)
    row = spark.read.parquet(f"{cfg.warehouse_directory}/meta/pipeline_run").first()
    assert row.status == "failed" and row.error.startswith("ContractError") and row.command == "ingest"


def test_only_allowed_columns_are_public(spark, tmp_path):
    """Columns are allowed by mart: `value` is a count of one mart's values, and unknown in another."""
    one = lambda name: spark.range(1).select(F.col("id").alias(name))
    for mart, name in (("daily_active_visitors", "visitorid"), ("daily_active_visitors", "value"), ("transaction_fact", "n_lines"), ("x", "d")):
        with pytest.raises(ValueError, match=name):
            sinks.write_public(one(name), str(tmp_path), mart)
    sinks.write_public(one("visitors"), str(tmp_path), "daily_active_visitors")
    sinks.write_public(one("value"), str(tmp_path), "property_value_counts")


def test_no_public_mart_has_an_id():
    ids = {"visitorid", "itemid", "transactionid", "event_id", "unit_id"}
    assert not any(columns & ids for columns in sinks.PUBLIC.values())


def test_config(tmp_path):
    home = {"TIDEMARK_DATA_HOME": "/srv/shop/data", "TIDEMARK_DEMO_MODE": "yes"}
    cfg = config.load(None, home)
    assert cfg.demo_mode and cfg.raw_data_dir == "/srv/shop/data/raw/extracted" and cfg.session_gap_minutes == 30
    texts = {
        "c.toml": '[paths]\ndata_home = "/srv/a/b"\n[project]\nname = "x"\nsession_gap_minutes = 45\n[warehouse]\nthreads = 4\n[dataset.files]\nevents = "e.csv"\n[dataset.rows]\nevents = 5\n',
        "c.yaml": "# note\ndata_home: '/srv/a/b'\nsession_gap_minutes: 45\n", "c.json": '\ufeff{"data_home": "/srv/a/b", "session_gap_minutes": 45}',
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
        cfg = config.load(str(tmp_path / name), home)
        assert (cfg.data_home, cfg.session_gap_minutes, cfg.demo_mode) == ("/srv/a/b", 45, True)
        assert cfg.expected_rows == ({"e.csv": 5} if name == "c.toml" else {})
    (tmp_path / "hash.yaml").write_text("data_home: /srv/a/b#1\n")
    assert config.load(str(tmp_path / "hash.yaml"), {}).data_home == "/srv/a/b#1"
    moved = config.build({"data_home": "/srv/a/b", "warehouse_directory": "/srv/a/b/w"})
    assert moved.database_path.startswith("/srv/a/b/w/") and moved.export_directory == "/srv/a/b/exports"
    wrong = [{"data_home": "/"}, {"data_home": "a/b/c"}, {"data_home": "/a/../b/c"}, {"data_home": "/srv/a/b", "raw_data_dir": "/srv/other"},
        {"data_home": "/srv/a/b", "sample": 1}, {}]
    wrong += [{"data_home": "/srv/a/b", "expected_rows": {"a": "many"}}, {"data_home": "/srv/a/b", "session_gap_minutes": 0}, {"data_home": "/srv/a/b", "demo_mode": "maybe"},
        {"data_home": str(Path.cwd())}, {"data_home": "D:\\x\\y", "temp_directory": "/tmp/x"}]
    for bad in wrong:
        with pytest.raises(config.ConfigError):
            config.build(bad)


def test_config_of_all_documented_keys(tmp_path):
    base = "D:\\\\Data\\\\shop"
    text = '[project]\nname = "shop"\ndemo_mode = false\nanalysis_timezone = "UTC"\nsession_gap_minutes = 30\nsynthetic_seed = 20260809\n[paths]\n'
    paths = {"data_home": "", "raw_data_dir": "raw", "warehouse_directory": "warehouse", "database_path": "warehouse\\\\x.duckdb",
        "parquet_directory": "parquet", "temp_directory": "tmp", "export_directory": "exports"}
    (tmp_path / "c.toml").write_text(text + "".join(f'{k} = "{base}{chr(92) * 2 * bool(v)}{v}"\n' for k,
        v in paths.items()) + '[warehouse]\nschemas = ["meta"]\nthreads = 4\n')
    cfg = config.load(str(tmp_path / "c.toml"), {})
    assert cfg.data_home == "D:\\Data\\shop" and cfg.database_path.endswith("x.duckdb") and set(cfg.to_dict()) >= set(paths)


def test_cli_reports_a_bad_config(tmp_path, capsys, monkeypatch):
    monkeypatch.delenv("TIDEMARK_DATA_HOME", raising=False)
    (tmp_path / "c.json").write_text('{"data_home": "/"}')
    assert cli.main(["ingest", "--config", str(tmp_path / "c.json")]) == 2
    out = capsys.readouterr()
    assert out.out == "" and "data_home" in out.err
    with pytest.raises(SystemExit) as e:
        cli.main(["--help"])
    listed = capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["--version"])
    assert capsys.readouterr().out.startswith("tidemark ")
    assert e.value.code == 0 and all(c in listed for c in cli.COMMANDS)


def test_stream_sessions(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, t0 + dt.timedelta(minutes=m), "view") for m in (0, 29, 59, 90)] + [(2, t0 + dt.timedelta(days=3), "view")]
    spark.createDataFrame(rows, "visitorid long, event_time timestamp, event string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = session_stream(spark.readStream.schema("visitorid long, event_time timestamp, event string").parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("closed_sessions").outputMode("append").option("checkpointLocation",
        str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.visitorid, r.n_events) for r in spark.table("closed_sessions").collect())
    assert got == [(1, 1), (1, 3)]
