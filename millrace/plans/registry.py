"""Every registered query of the library and its SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from millrace.scratch import joins_by_measured_size

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "p14_band_predicate"
MODULES = ("series_queries", "scoring_queries", "record_queries", "source_queries", "report_queries")


def _all() -> dict[str, tuple[Query, str | None]]:
    found: dict[str, tuple[Query, str | None]] = {}
    for name in MODULES:
        found |= import_module(f"millrace.plans.{name}").QUERIES
    return found


def _measured(f: Query) -> Query:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        joins_by_measured_size(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    return {name: _measured(f) for name, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
