"""Exact percentiles of a column by rank selection in rounds: no bucket of more than a few thousand values is ever ordered."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scratch import written

#: Cuts of a round, values that the sketch may misplace (1 / ACCURACY of all), values of a bucket that is ordered: so many
#: at most, and a thousandth of all unless that is below LEAST.
CUTS, ACCURACY, LARGEST, SHARE, LEAST = 63, 1000, 20_000, 1000, 50


@dataclass(frozen=True)
class _Range:
    """Values of the group by between low and high (exclusive; None: without bound) of which a rank is wanted."""

    by: tuple
    low: float | None
    high: float | None
    before: int  # values of the group up to low
    n: int  # values in the range
    cuts: tuple[float, ...]


def _tree(x: Column, cuts: tuple[float, ...], low: int = 0) -> Column:
    """The place of x among the cuts by halving: 2 k between cut k - 1 and cut k, 2 k + 1 at cut k."""
    if not cuts:
        return F.lit(2 * low)
    k = len(cuts) // 2
    cut = F.lit(cuts[k])
    return F.when(x < cut, _tree(x, cuts[:k], low)).when(x > cut, _tree(x, cuts[k + 1 :], low + k + 1)).otherwise(2 * (low + k) + 1)


def _within(r: _Range, by: list[str]) -> Column:
    found = F.lit(True)
    for c, v in zip(by, r.by):
        found = found & F.col(c).eqNullSafe(F.lit(v))
    if r.low is not None:
        found = found & (F.col("x") > r.low)
    if r.high is not None:
        found = found & (F.col("x") < r.high)
    return found


def _sketch() -> Column:
    at = ", ".join(f"{(k + 1) / (CUTS + 1)}D" for k in range(CUTS))
    return F.expr(f"percentile_approx(x, array({at}), {ACCURACY})").alias("cuts")


def _select(src: DataFrame, by: list[str], ranks: dict[tuple, set[int]], sizes: dict[tuple, tuple[int, tuple]]) -> tuple[dict, int]:
    """The value of each wanted rank (from 0) of each group, and the largest bucket that was ordered.

    A round cuts each range that holds a wanted rank at sketched quantiles, counts the buckets in one pass, and goes on with
    the buckets of the ranks; a rank that falls on a cut is found. The driver sees 2 CUTS + 1 rows for each range."""
    found: dict[tuple, float] = {}
    largest = 0
    live = {_Range(g, None, None, 0, sizes[g][0], tuple(sorted(set(sizes[g][1])))): set(r) for g, r in ranks.items() if r}
    limit = {g: min(LARGEST, max(LEAST, n // SHARE)) for g, (n, _) in sizes.items()}
    while live:
        small = {r: want for r, want in live.items() if r.n <= limit[r.by]}
        for r, want in small.items():
            largest = max(largest, r.n)
        if small:
            number = F.coalesce(*[F.when(_within(r, by), k) for k, r in enumerate(small)])
            rows = src.withColumn("_r", number).where("_r is not null").groupBy("_r").agg(F.sort_array(F.collect_list("x")).alias("v"))
            wanted = F.create_map(*[c for k, (r, want) in enumerate(small.items()) for c in (F.lit(k),
                F.array(*[F.lit(w - r.before) for w in sorted(want)]))])
            got = rows.select("_r", F.transform(wanted[F.col("_r")], lambda i: F.get("v", i)).alias("v")).collect()
            for row in got:
                r, want = list(small.items())[row["_r"]]
                found |= {(r.by, w): v for w, v in zip(sorted(want), row["v"])}
        live = {r: want for r, want in live.items() if r not in small}
        if not live:
            break
        ranges = list(live)
        number = F.coalesce(*[F.when(_within(r, by), k) for k, r in enumerate(ranges)])
        bucket = F.coalesce(*[F.when(F.col("_r") == k, _tree(F.col("x"), r.cuts)) for k, r in enumerate(ranges)])
        counts = src.withColumn("_r", number).where("_r is not null").groupBy("_r", bucket.alias("bucket")).agg(F.count("*").alias("n"), _sketch())
        seen: dict[int, list] = {}
        for row in counts.collect():
            seen.setdefault(row["_r"], []).append(row)
        after: dict[_Range, set[int]] = {}
        for k, r in enumerate(ranges):
            upto = r.before
            for row in sorted(seen[k], key=lambda x: x["bucket"]):
                inside = {w for w in live[r] if upto <= w < upto + row["n"]}
                b = row["bucket"]
                if inside and b % 2:
                    found |= {(r.by, w): r.cuts[b // 2] for w in inside}
                elif inside:
                    ends = (r.cuts[b // 2 - 1] if b else r.low, r.cuts[b // 2] if b // 2 < len(r.cuts) else r.high)
                    after[_Range(r.by, *ends, upto, row["n"], tuple(sorted(set(row["cuts"]))))] = inside
                upto += row["n"]
        live = after
    return found, largest


def percentiles(df: DataFrame, x: str, which: dict[str, float], by: tuple[str, ...] = (), about: dict | None = None) -> DataFrame:
    """by, n (values that are not null) and one column for each percentile, interpolated between neighbours; null where
    there is no value. by has few values. Infinite values are the ends of the order and NaN comes after all; a percentile
    between such neighbours is what arithmetic makes of them.

    Runs at once, in rounds: of 10^13 values a bucket of 20,000 is left after five. The values are written once. about: gets
    the size of the largest bucket that was ordered (`largest`)."""
    by = list(by)
    src = written(df.select(*by, F.col(x).cast("double").alias("x")), "values")
    known = src.where("x is not null")
    sizes = {tuple(r[c] for c in by): (r["n"], r["cuts"] or ()) for r in src.groupBy(*by).agg(F.count("x").alias("n"), _sketch()).collect()}
    at = lambda p, n: p * (n - 1)
    ranks = {g: {f(at(p, n)) for p in which.values() for f in (floor, ceil)} if n else set() for g, (n, _) in sizes.items()}
    found, largest = _select(known, by, ranks, sizes)
    if about is not None:
        about["largest"] = largest
    rows = []
    for g, (n, _) in sizes.items():
        values = []
        for p in which.values():
            if n:
                a, b = found[g, floor(at(p, n))], found[g, ceil(at(p, n))]
                values.append(a if a == b else a + (at(p, n) - floor(at(p, n))) * (b - a))
            else:
                values.append(None)
        rows.append((*g, n, *values))
    names = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in by)
    schema = ", ".join([*([names] if by else []), "n long", *[f"`{k}` double" for k in which]])
    return df.sparkSession.createDataFrame(rows or ([] if by else [(0, *[None] * len(which))]), schema)
