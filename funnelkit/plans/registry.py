"""Registry of named queries over the driver tables: each entry holds the Spark
plan builder and, where SQL can express it, an independent DuckDB oracle
written in the reference's own shape (laterals, DISTINCT ON, FILTER)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from funnelkit.sources.tables import load


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ids: str


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None, ids: str = ""):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, fn, sql, ids)
        return fn
    return deco


class Tables:
    """Lazy table accessor: ``T(spark, d).orders`` reads ``orders.parquet``."""

    def __init__(self, spark: SparkSession, base: str):
        self._spark, self._base, self._loaded = spark, base, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        # one scan definition per table and query (file listing and footers
        # are read once while the plan is built)
        if name not in self._loaded:
            self._loaded[name] = load(self._spark, self._base, name)
        return self._loaded[name]


@lru_cache(maxsize=1)
def _load_all_modules():
    from funnelkit.plans import (catalog_lookup, catalog_agg, catalog_reports,  # noqa: F401
                                 catalog_scalar, catalog_extracts, catalog_leads)
    return True


def all_queries() -> dict[str, Query]:
    _load_all_modules()
    return QUERIES


def run(name: str, spark: SparkSession, base: str, **params) -> DataFrame:
    """Build a registered report with its run parameters, e.g.
    ``run("funnel_rollup", spark, path, first_day="2000-01-01", last_day="2000-01-31")``.
    Parameters default to the values the registered query uses."""
    return all_queries()[name].build(spark, base, **params)
