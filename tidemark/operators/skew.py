"""Keys that hold so many rows that a task of their own would not do: found by counting, and kept apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it is among the PARTS most frequent ones and has LEAST rows or more. Every other key holds less than one in PARTS of
#: all rows, or too few to matter.
PARTS, LEAST = 2000, 1_000_000


def hot_keys(df: DataFrame, key: str, least: int | None = None) -> DataFrame | None:
    """The hot values of a column (PARTS at most; null may be one), or None. One pass over the column, counted before it is shuffled."""
    n = LEAST if least is None else least
    top = df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= n).orderBy(F.desc("_n"), key).limit(PARTS).select(key)
    rows = top.collect()
    return df.sparkSession.createDataFrame(rows, top.schema) if rows else None


def apart(df: DataFrame, key: str, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of hot keys, and all others."""
    keys = F.broadcast(hot.select(F.col(key).alias("_hot")))  # PARTS rows at most
    same = F.col(key).eqNullSafe(F.col("_hot"))
    return df.join(keys, same, "left_semi"), df.join(keys, same, "left_anti")


def by_heat(dfs: list[DataFrame], key: str, plain: Callable[..., DataFrame], split: Callable[..., DataFrame], least: int | None = None) -> DataFrame:
    """plain(*dfs), which has all rows of a key in one task; where the first table has hot keys, split(*dfs) for these."""
    hot = hot_keys(dfs[0], key, least)
    if hot is None:
        return plain(*dfs)
    pairs = [apart(df, key, hot) for df in dfs]
    return split(*[x for x, _ in pairs]).unionByName(plain(*[y for _, y in pairs]))
