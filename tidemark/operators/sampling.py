"""Reproducible samples: rows are ordered by a seeded hash of their key, never by rand()."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = "42"


class Refused(ValueError):
    """A sample whose definition the data does not meet."""


def order_of(key: Column, seed: str = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def sample(df: DataFrame, key: str, n: int, seed: str = SEED) -> DataFrame:
    """Exactly n rows (all if there are fewer): a distributed top-n by hash."""
    return df.orderBy(order_of(F.col(key), seed), key).limit(n)


def pool(candidates: DataFrame, wanted: Column, n: int) -> DataFrame:
    """The candidates that are wanted if they are n or more, else all candidates; raises Refused where these are fewer than n."""
    preferred = candidates.where(wanted)
    if preferred.limit(n).count() >= n:
        return preferred
    if (found := candidates.limit(n).count()) < n:
        raise Refused(f"{found} candidates, {n} are needed")
    return candidates


def budgeted(df: DataFrame, keep: Column, key: str, budget: int, seed: str = SEED) -> DataFrame:
    """All rows that keep names, and a sample of the others up to the budget (none if the first are over it).

    The rest is ordered by hash with the budget as limit, and cut to what the kept rows leave of it, so no count runs before."""
    kept = df.where(keep)
    rest = sample(df.where(~keep), key, budget, seed)
    place = F.row_number().over(Window.orderBy(order_of(F.col(key), seed), key))  # over the budget's rows at most
    left = kept.agg(F.greatest(F.lit(0), F.lit(budget) - F.count("*")).alias("_left"))
    rest = rest.withColumn("_place", place).join(F.broadcast(left)).where("_place <= _left").drop("_place", "_left")  # one row
    return kept.unionByName(rest)
