"""Query registry: key -> (Spark query builder, DuckDB oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    key: str
    fn: QueryFn
    sql: str | None
    bench: bool = False
    long: bool = False


REGISTRY: dict[str, Entry] = {}


def register(key: str, sql: str | None = None, bench: bool = False, long: bool = False):
    def deco(fn: QueryFn) -> QueryFn:
        if key in REGISTRY:
            raise ValueError(f"duplicate query key {key!r}")
        REGISTRY[key] = Entry(key, fn, sql, bench, long)
        return fn
    return deco
