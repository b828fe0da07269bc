"""Campaign and experiment metrics on synthetic data, made from a number of units alone: unit k of n is a hash of k, so nothing of it goes back to a visitor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.rates import Z95, hash_unit, rate, two_sided_p

SEED = "20260809"
CHANNELS = ("search", "social", "email", "display")
#: Rates of the control arm, and what the treatment adds in each scenario.
CLICK, CONVERT, LIFT = 0.30, 0.20, {"no_effect": 0.0, "positive_effect": 0.05}


def impressions(spark: SparkSession, n: int, seed: str = SEED) -> DataFrame:
    """One synthetic impression for each of n units and scenario: unit (a hash), channel, arm, clicked, converted, cost, amount."""
    keys, key = spark.range(n), "id"
    u = lambda what: hash_unit(F.col(key), f"{seed}-{what}")
    base = keys.select(F.md5(F.concat(F.lit(f"{seed}:unit:"), F.col(key).cast("string"))).alias("unit"), u("channel").alias("c"),
        u("arm").alias("a"), u("click").alias("k"), u("convert").alias("v"), u("amount").alias("m"))
    base = base.select("*", F.explode(F.array(*[F.struct(F.lit(s).alias("scenario"), F.lit(x).alias("lift")) for s, x in LIFT.items()])).alias("s"))
    arm = F.when(F.col("a") < 0.5, "control").otherwise("treatment")
    clicked = F.col("k") < CLICK
    limit = F.lit(CONVERT) + F.when(F.col("a") < 0.5, 0.0).otherwise(F.col("s.lift"))
    channel = F.get(F.array(*[F.lit(c) for c in CHANNELS]), F.floor(F.col("c") * len(CHANNELS)).cast("int"))
    out = base.select("unit", F.col("s.scenario").alias("scenario"), channel.alias("channel"), arm.alias("arm"), clicked.alias("clicked"),
        (clicked & (F.col("v") < limit)).alias("converted"), F.round(F.col("m") * 90 + 10, 2).alias("amount"))
    return out.select("*", F.when(F.col("clicked"), 0.5).otherwise(0.01).alias("cost"), F.lit("synthetic").alias("data_origin"))


def campaign(data: DataFrame) -> DataFrame:
    """Per scenario and channel: click-through, conversion (per click and impression), acquisition cost, return on spend,
    gross value and average order value."""
    s = data.groupBy("scenario", "channel").agg(
        F.count("*").alias("impressions"), F.count_if("clicked").alias("clicks"), F.count_if("converted").alias("conversions"),
            F.round(F.sum("cost"), 4).alias("cost"), F.round(F.coalesce(F.sum(F.when(F.col("converted"), F.col("amount"))), F.lit(0.0)),
                4).alias("gmv")
    )
    r = lambda a, b: F.round(rate(F.col(a), F.col(b)), 6)
    return s.select("*", r("clicks", "impressions").alias("click_through_rate"), r("conversions", "clicks").alias("conversion_per_click"),
        r("conversions", "impressions").alias("conversion_per_impression"), r("cost", "conversions").alias("acquisition_cost"),
            r("gmv", "cost").alias("return_on_spend"), r("gmv", "conversions").alias("average_order_value"))


def two_proportions(data: DataFrame, by: str = "scenario", outcome: str = "converted", guardrail: str = "clicked") -> DataFrame:
    """Per scenario: sample sizes, rates, absolute and relative uplift, unpooled 95 % interval, pooled two-sided p-value,
    and the guardrail's rates."""
    n = lambda arm, what=None: F.count_if((F.col("arm") == arm) & (F.col(what) if what else F.lit(True))).cast("double")
    s = data.groupBy(by).agg(n("control").alias("n0"), n("treatment").alias("n1"), n("control", outcome).alias("x0"),
        n("treatment", outcome).alias("x1"), n("control", guardrail).alias("g0"), n("treatment", guardrail).alias("g1"))
    c = {k: F.col(k) for k in ("n0", "n1", "x0", "x1", "g0", "g1")}
    p0, p1, p = c["x0"] / c["n0"], c["x1"] / c["n1"], (c["x0"] + c["x1"]) / (c["n0"] + c["n1"])
    half = F.sqrt(p0 * (1 - p0) / c["n0"] + p1 * (1 - p1) / c["n1"]) * Z95
    z = F.try_divide(p1 - p0, F.sqrt(p * (1 - p) * (1 / c["n0"] + 1 / c["n1"])))
    s = s.where("n0 > 0 and n1 > 0")
    return s.select(
        by, c["n0"].cast("long").alias("n_control"), c["n1"].cast("long").alias("n_treatment"), F.round(p0, 9).alias("rate_control"),
            F.round(p1, 9).alias("rate_treatment"), F.round(p1 - p0, 9).alias("absolute_uplift"),
        F.round(F.try_divide(p1 - p0, p0), 9).alias("relative_uplift"), F.round(p1 - p0 - half, 9).alias("ci_low"),
            F.round(p1 - p0 + half, 9).alias("ci_high"), F.round(z, 6).alias("z"), F.round(two_sided_p(z), 6).alias("p_value"),
        F.round(c["g0"] / c["n0"], 9).alias("guardrail_control"), F.round(c["g1"] / c["n1"], 9).alias("guardrail_treatment"),
    )
