"""All registered queries and their oracle SQL; the modules of queries fill it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tagloom.plans.fixtures import oracle

FLAGSHIP = "e5_tag_stats"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(text: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) under its name, with oracle SQL if SQL can express it."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        register(f.__name__, f, text)
        return f

    return add


def register(name: str, f: Callable[[SparkSession, str], DataFrame], text: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"two queries are named {name}")
    QUERIES[name] = f
    if text:
        ORACLE[name] = oracle(text)


from tagloom.plans import captions, layouts, lookups, quotas, records, scalars, tags  # noqa: E402, F401
