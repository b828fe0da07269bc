"""Marts in versions: written to a folder of their inputs, settings and code, and published by one row of a log.

A mart goes to mart/<key>/<name>, where key is a hash of the source files' hashes, the configuration and the code version. When
all marts of a run are there, a row is appended to meta/published; the last row says which folder each mart is read from. So a run
that is killed leaves what was published before, nothing that is being read is deleted, and a run with the same key writes only
what is missing."""

from __future__ import annotations

import hashlib
import json
import time
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Marts that are laid out by day, so that filters of the day read the days' files alone.
BY_DAY = frozenset({"daily_category_sessions", "daily_visitors_by_segment", "session_fact"})
LOG = "seq double, key string, marts string, refused string"


@dataclass
class Published:
    """What can be read: the key, the folder of each mart, and the reasons of those that were refused."""

    key: str = ""
    marts: dict[str, str] = field(default_factory=dict)
    refused: dict[str, str] = field(default_factory=dict)


def key_of(input_hash: str, settings: dict, commit: str | None) -> str:
    return hashlib.sha256(json.dumps([input_hash, settings, commit], sort_keys=True, default=str).encode()).hexdigest()[:20]


def published(spark: SparkSession, store: str) -> Published:
    """The last published state; an empty one before the first."""
    try:
        rows = spark.read.schema(LOG).parquet(f"{store}/meta/published").orderBy(F.desc("seq")).limit(1).collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = []
    return Published(rows[0]["key"], json.loads(rows[0]["marts"]), json.loads(rows[0]["refused"])) if rows else Published()


def write(df: DataFrame, path: str, name: str) -> None:
    """A mart, not yet published."""
    out = df.repartition("d").write.partitionBy("d") if name in BY_DAY else df.write
    out.mode("overwrite").parquet(path)


def publish(spark: SparkSession, store: str, state: Published) -> None:
    row = (time.time(), state.key, json.dumps(state.marts), json.dumps(state.refused))
    spark.createDataFrame([row], LOG).coalesce(1).write.mode("append").parquet(f"{store}/meta/published")


def read(spark: SparkSession, store: str, name: str) -> DataFrame:
    """A published mart."""
    return spark.read.parquet(f"{store}/{published(spark, store).marts[name]}")
