"""Where queries register: the Spark callable, its SQL twin and its metadata."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Run
    sql: str | None
    grain: str
    origin: str  # real or synthetic


REGISTRY: dict[str, Query] = {}


def query(name: str, grain: str, sql: str | None = None, origin: str = "real") -> Callable[[Run], Run]:
    def add(run: Run) -> Run:
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")
        REGISTRY[name] = Query(name, run, sql, grain, origin)
        return run

    return add
