"""Where results go: marts, public aggregates, run log. Every write replaces, so a second run changes nothing."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RATE = "numerator denominator rate small_sample"
#: The columns that each mart may show in public: days and groups, counts and rates, no id of a visitor, event, item or transaction.
#: A mart that is not named here is not public.
PUBLIC = {name: frozenset(columns.split()) | {"data_origin"} for name, columns in {
    "behavior_coverage_rate": f"unit event {_RATE}",
    "campaign_metrics": """scenario channel impressions clicks conversions cost gmv click_through_rate conversion_per_click
        conversion_per_impression acquisition_cost return_on_spend average_order_value""",
    "category_conversion": "level category viewing transacting converted literal_rate enough opportunity low high",
    "category_events_with_unknown": "category n_events",
    "category_linkage_rate": _RATE,
    "category_opportunity_rank": "level category opportunity place",
    "category_tree": "categoryid depth root path",
    "category_tree_defects": "kind findings",
    "daily_active_visitors": "d visitors",
    "daily_category_sessions": "d level category cohort segment viewing transacting converted",
    "daily_visitors_by_segment": "d cohort segment visitors",
    "dau_mau_stickiness": f"d {_RATE} is_full_window",
    "distinct_items_per_transaction": "transactions mean median p75",
    "events_per_session": "d grain events sessions mean median p75",
    "experiment_test": """scenario n_control n_treatment rate_control rate_treatment absolute_uplift relative_uplift ci_low ci_high z
        p_value guardrail_control guardrail_treatment""",
    "first_observed_visitors": "d visitors",
    "hypothesis_cart_retention": f"kind {_RATE} supported",
    "hypothesis_lost_step": f"step {_RATE} supported",
    "hypothesis_weak_category": "level categories weak supported",
    "item_property_coverage_rate": _RATE,
    "items_per_session": "sessions median p75",
    "lifecycle_segments": "segment visitors",
    "main_paths": "path sessions wide_sessions",
    "median_step_latency": "step n median p75",
    "null_rates": f"column_name {_RATE}",
    "order_anomalies": "sessions purchase_without_view purchase_without_cart cart_before_view purchase_before_cart",
    "ordered_funnel_rates": f"gap_minutes metric_id {_RATE}",
    "property_value_counts": "value n",
    "purchasing_visitor_rate": _RATE,
    "quality_report": "check_id findings checked",
    "repeat_purchase_visitor_rate": _RATE,
    "repurchase_interval_days": "gaps median p75",
    "repurchase_within_90_days": _RATE,
    "retention_by_cohort": "first_d n cohort_size retained rate",
    "retention_overall": f"n {_RATE}",
    "retention_weekly_orders": f"week n {_RATE}",
    "returning_visitors": "d visitors",
    "rolling_30d_active_visitors": "d visitors is_full_window",
    "rolling_7d_active_visitors": "d visitors is_full_window",
    "row_counts": "table_name n_rows expected as_expected",
    "same_item_funnel_rate": f"metric_id {_RATE}",
    "sample_coverage": f"ratio {_RATE}",
    "session_count": "d sessions",
    "session_duration_seconds": "sessions median p75",
    "transaction_count": "d grain transactions",
}.items()}


def write_mart(df: DataFrame, folders: dict[str, str], name: str, origin: str = "real") -> None:
    """The mart in each format of folders (format: folder), with its data_origin."""
    marked = df if "data_origin" in df.columns else df.withColumn("data_origin", F.lit(origin))
    for kind, folder in folders.items():
        plain = marked.select(*[F.to_json(c).alias(c) if isinstance(marked.schema[c].dataType, T.ArrayType) and kind == "csv" else c
            for c in marked.columns])
        plain.write.mode("overwrite").options(**({"header": "true"} if kind == "csv" else {})).format(kind).save(f"{folder}/{name}.{kind}")


def is_public(df: DataFrame, name: str) -> bool:
    return set(df.columns) <= PUBLIC.get(name, frozenset())


def write_public(df: DataFrame, folder: str, name: str) -> None:
    """An aggregate all of whose columns are allowed in public for this mart."""
    if held := set(df.columns) - PUBLIC.get(name, frozenset()):
        raise ValueError(f"{name}: not for the public: {sorted(held)}")
    df.write.mode("overwrite").option("header", True).csv(f"{folder}/public/{name}.csv")


def write_quality_json(df: DataFrame, folder: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(f"{folder}/quality.json")  # a row per check


LOG = "run_id string, command string, started double, ended double, status string, input_hash string, commit string, error string"


def log_run(spark: SparkSession, folder: str, run_id: str, command: str, started: float, status: str, input_hash: str, error: str | None = None,
    commit: str | None = None) -> None:
    """Appends one row to the run log, also for a run that failed."""
    row = [(run_id, command, started, time.time(), status, input_hash, commit, error)]
    spark.createDataFrame(row, LOG).write.mode("append").parquet(f"{folder}/meta/pipeline_run")


def write_manifest(spark: SparkSession, folder: str, about: dict) -> None:
    """The run manifest (JSON) and a summary of its figures (Markdown), each a one-row text."""
    for name, text in (("run_manifest.json", json.dumps(about, ensure_ascii=False, default=str)), ("summary.md", summary(about))):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}")


def write_sheets(sheets: dict[str, DataFrame], folder: str, metadata: dict) -> None:
    """A sample for reading by people: each sheet, in the order of its rows, and the metadata as JSON with all characters kept.
    The sheets are samples of bounded size."""
    for name, df in sheets.items():
        df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(f"{folder}/sheets/{name}.json")
    spark = next(iter(sheets.values())).sparkSession
    about = metadata | {"headers": {name: df.schema.jsonValue() for name, df in sheets.items()}}
    text = json.dumps(about, ensure_ascii=False, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/sheets/metadata.json")


def read_sheets(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], dict]:
    """The sheets and metadata that write_sheets wrote, with the columns in their order."""
    about = json.loads(spark.read.text(f"{folder}/sheets/metadata.json").first()[0])
    read = lambda name, schema: spark.read.schema(T.StructType.fromJson(schema)).json(f"{folder}/sheets/{name}.json")
    return {name: read(name, schema) for name, schema in about["headers"].items()}, about


def summary(rows: dict) -> str:
    """Markdown of a few figures."""
    return "\n".join(["| figure | value |", "|-|-|", *(f"| {k} | {json.dumps(v, ensure_ascii=False, default=str)} |" for k, v in rows.items())])
