"""Commands over the source files: ingest, build, metrics, validate, export, run-all."""

from __future__ import annotations

import argparse
import hashlib
import json
import os
import sys
import time
import uuid
from collections.abc import Iterable
from functools import reduce

from tidemark import __version__
from tidemark.config import Config, ConfigError, load

# The commands.
COMMANDS = ("ingest", "build", "metrics", "validate", "export", "run-all")
#: Samples that `export` writes as sheets, with the order of their rows.
SHEETS = {
    "sample_events": ("event_id",), "sample_journeys": ("visitorid", "us", "event_id"),
        "sample_properties": ("priority", "itemid", "property", "us", "value"), "category_ancestors": ("categoryid",),
}
#: Marts of single checks that `validate` adds to the quality report, as (numerator, denominator) columns.
RATIOS = ("item_property_coverage_rate", "category_linkage_rate")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("tidemark")
    top.add_argument("--version", action="version", version=f"tidemark {__version__}")
    top.add_argument("--config", dest="top_config")
    top.add_argument("--json", action="store_true", dest="top_json")
    sub = top.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        p = sub.add_parser(name)
        p.add_argument("--config")
        p.add_argument("--json", action="store_true")
    return top


def warehouse(cfg: Config):
    """The place that queries read, with the settings that act on them."""
    from tidemark.sources.tables import Warehouse

    return Warehouse(cfg.warehouse_directory, cfg.session_gap_minutes, cfg.synthetic_seed)


def _ingest(spark, cfg: Config, done: dict) -> None:
    """raw: the files' cells as text, with lineage; then, if they keep the contract, stg: typed and flagged."""
    from tidemark.sources import contract

    store = cfg.warehouse_directory
    write = lambda df, name: df.write.mode("overwrite").parquet(f"{store}/{name}")
    write(contract.manifest(spark, cfg.raw_data_dir, cfg.expected_rows, done["commit"]), "meta/source_file_manifest")
    for source in contract.CONTRACT:
        write(contract.scan(spark, cfg.raw_data_dir, source), f"raw/{source}")
    raw = {source: spark.read.parquet(f"{store}/raw/{source}") for source in contract.CONTRACT}
    for source in raw:
        contract.check(raw[source], source, f"{store}/meta/contract_diff/run={done['run_id']}")
    write(contract.events(raw["events"], cfg.analysis_timezone), "stg/events")
    write(contract.properties(raw["item_properties"]), "stg/item_properties")
    write(contract.typed(raw["category_tree"], "category_tree").drop("block", "place"), "stg/category_tree")
    done["rows"] = {n: spark.read.parquet(f"{store}/stg/{n}").count() for n in contract.CONTRACT}


def _build(spark, cfg: Config) -> None:
    """Facts and dimensions: events with sessions, sessions with their funnel steps, transactions, property history, categories,
    visitors. Sessions are made once, here; marts at this gap read them without a shuffle by visitor."""
    from tidemark.operators import funnel, sessions, taxonomy, visitors
    from tidemark.plans import behaviour, commerce  # noqa: F401  they register their queries
    from tidemark.plans.registry import REGISTRY
    from tidemark.sources import tables

    store, w = cfg.warehouse_directory, warehouse(cfg)
    read = lambda name: spark.read.parquet(f"{store}/{name}")
    write = lambda df, name: df.write.mode("overwrite").parquet(f"{store}/{name}")
    write(sessions.sessionize(read("stg/events"), cfg.session_gap_minutes * sessions.MINUTE), "core/fct_event")
    keys = ["visitorid", "session_number"]
    write(sessions.session_fact(read("core/fct_event")).join(funnel.steps(read("core/fct_event"), keys), keys), "core/fct_session")
    write(REGISTRY["transaction_fact"].run(spark, w), "core/fct_transaction")
    tables.write_history(tables.value_ranges(tables.property_log(spark, w)), store)
    write(taxonomy.with_paths(tables.category_tree(spark, w)), "core/dim_category")
    write(visitors.segments(visitors.profiles(read("core/fct_event"))), "core/visitor_profile")


def _metrics(spark, cfg: Config, done: dict, marts: Iterable[str] | None) -> None:
    """Every registered mart over the facts, published when all are there. One that its definition refuses (a sample from too few
    visitors) is named, and is not published. Marts that the same inputs, settings and code have published are left as they are."""
    from tidemark.operators.sampling import Refused
    from tidemark.plans import behaviour, commerce  # noqa: F401  they register their queries
    from tidemark.plans.registry import REGISTRY
    from tidemark.sources import publish

    w, store = warehouse(cfg), cfg.warehouse_directory
    key = publish.key_of(_input_hash(spark, store), cfg.to_dict(), done["commit"])
    state = publish.published(spark, store)
    if state.key != key:
        state = publish.Published(key)
    names = list(marts or sorted(REGISTRY))
    done["marts"], done["refused"], done["unchanged"] = [], {}, [n for n in names if n in state.marts]
    for name in names:
        if name in state.marts:
            continue
        try:
            publish.write(REGISTRY[name].run(spark, w), f"{store}/mart/{key}/{name}", name)
            state.marts[name] = f"mart/{key}/{name}"
            done["marts"].append(name)
        except Refused as e:
            state.refused[name] = done["refused"][name] = str(e)
    publish.publish(spark, store, state)


def _validate(spark, cfg: Config, done: dict) -> None:
    """All quality checks as rows of check_id, findings and checked."""
    from pyspark.sql import DataFrame
    from pyspark.sql import functions as F

    from tidemark.plans import behaviour, commerce  # noqa: F401
    from tidemark.plans.registry import REGISTRY
    from tidemark.sources import sinks, tables

    w = warehouse(cfg)
    of = lambda name: REGISTRY[name].run(spark, w)
    check = lambda df, name, a, b: df.select(F.lit(name).alias("check_id") if isinstance(name, str) else name.alias("check_id"),
        F.expr(a).cast("long").alias("findings"), F.expr(b).cast("long").alias("checked"))
    raw = spark.read.parquet(f"{cfg.warehouse_directory}/stg/item_properties")
    values = raw.agg(F.count_if("is_bad_category").alias("a"), F.count_if(F.col("property") == "categoryid").alias("b"))
    tree = tables.category_tree(spark, w).agg(F.count("*").alias("b"))
    visitors = spark.read.parquet(f"{cfg.warehouse_directory}/core/visitor_profile").agg(F.count("*").alias("b"))
    manifest = spark.read.parquet(f"{cfg.warehouse_directory}/meta/source_file_manifest")
    files = manifest.agg(F.count_if(~F.col("rows_as_expected")).alias("a"), F.count("*").alias("b"))
    parts = [
        of("quality_report").select("check_id", "findings", "checked"),
        check(of("category_tree_defects").join(F.broadcast(tree)), F.concat(F.lit("tree_"), "kind"), "findings", "b"),  # one row
        check(of("null_rates"), F.concat(F.lit("null_"), "column_name"), "numerator", "denominator"),
        check(of("row_counts"), F.concat(F.lit("rows_"), "table_name"), "coalesce(abs(n_rows - expected), 0)", "n_rows"),
        check(of("property_value_counts"), F.concat(F.lit("available_"), F.coalesce("value", F.lit("null"))), "if(value in ('0', '1'), 0, n)", "n"),
        check(values, "category_not_a_number", "a", "b"),
        check(files, "files_with_unexpected_rows", "a", "b"),
        check(of("as_of_leakage"), "as_of_leakage", "leaks", "matched"),
        check(of("abnormal_visitors").agg(F.count("*").alias("a")).join(F.broadcast(visitors)), "abnormal_visitors", "a", "b"),  # one row
        *[check(of(name), f"without_{name.removesuffix('_rate')}", "denominator - numerator", "denominator") for name in RATIOS],
    ]
    checks = reduce(DataFrame.unionByName, parts)
    sinks.write_quality_json(checks, cfg.export_directory)
    done["quality"] = {r["check_id"]: r["findings"] for r in spark.read.json(f"{cfg.export_directory}/quality.json").collect()}


def _export(spark, cfg: Config, done: dict, marts: Iterable[str] | None) -> None:
    """The published marts, or those of them that are named: Parquet, CSV, public aggregates, and samples as sheets."""
    from tidemark.operators import sampling
    from tidemark.plans import behaviour, commerce  # noqa: F401
    from tidemark.plans.registry import REGISTRY
    from tidemark.sources import publish, sinks

    state = publish.published(spark, cfg.warehouse_directory)
    names = [n for n in (marts or sorted(state.marts)) if n in state.marts]
    done["public"], done["exported"], done["not_published"] = [], names, sorted(set(marts or ()) - set(names))
    found = {n: spark.read.parquet(f"{cfg.warehouse_directory}/{state.marts[n]}") for n in names}
    samples = {name: df for name, df in found.items() if name in SHEETS}
    if samples:
        order = {name: [c for c in columns if c in samples[name].columns] for name, columns in SHEETS.items() if name in samples}
        counts = {name: df.count() for name, df in samples.items()}
        about = {"seed": sampling.SEED, "session_gap_minutes": cfg.session_gap_minutes, "counts": counts}
        sinks.write_sheets({name: df.orderBy(*order[name]) for name, df in samples.items()}, cfg.export_directory, about)
    for name, df in found.items():
        origin = "synthetic" if cfg.demo_mode else REGISTRY[name].origin
        sinks.write_mart(df, {"parquet": cfg.parquet_directory, "csv": cfg.export_directory}, name, origin)
        if sinks.is_public(df, name):
            sinks.write_public(df, cfg.export_directory, name)
            done["public"].append(name)


def run(command: str, cfg: Config, spark=None, marts: Iterable[str] | None = None) -> dict:
    """Runs a command; later ones read what earlier ones wrote. marts: only these of metrics and export."""
    from pyspark.sql import SparkSession

    from tidemark.plans import behaviour, commerce  # noqa: F401
    from tidemark.sources import sinks

    spark = spark or SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(cfg.temp_directory)  # tables between jobs
    run_id, began, store = uuid.uuid4().hex, time.time(), cfg.warehouse_directory
    done: dict = {"command": command, "run_id": run_id, "data_origin": "synthetic" if cfg.demo_mode else "real",
        "commit": os.environ.get("TIDEMARK_COMMIT")}
    status, error = "failed", None
    try:
        for step in COMMANDS[:-1] if command == "run-all" else (command,):
            if step == "ingest":
                _ingest(spark, cfg, done)
            elif step == "build":
                _build(spark, cfg)
            elif step == "metrics":
                _metrics(spark, cfg, done, marts)
            elif step == "validate":
                _validate(spark, cfg, done)
            elif step == "export":
                _export(spark, cfg, done, marts)
        done["input_hash"] = _input_hash(spark, store)
        sinks.write_manifest(spark, cfg.export_directory, done)
        status = "ok"
    except Exception as e:
        error = f"{type(e).__name__}: {e}"[:2000]
        raise
    finally:
        sinks.log_run(spark, store, run_id, command, began, status, done.get("input_hash") or "", error, done["commit"])
    return done


def _input_hash(spark, store: str) -> str:
    """One hash of all source files' hashes."""
    rows = spark.read.parquet(f"{store}/meta/source_file_manifest").select("file", "sha256").orderBy("file").collect()  # a row per file
    return hashlib.sha256("".join(f"{r['file']}:{r['sha256']};" for r in rows).encode()).hexdigest()


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        cfg = load(a.config or a.top_config)
    except ConfigError as e:
        print(f"configuration: {e}", file=sys.stderr)
        return 2
    out = run(a.command, cfg)
    print(json.dumps(out, default=str) if a.json or a.top_json else "\n".join(f"{k}: {v}" for k, v in out.items()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
