"""Registered catalogue queries: one Spark callable and (where SQL can say
it) one DuckDB oracle statement per operator of the blueprint inventory.

Each Spark callable takes ``(spark, sf_dir)`` and returns a lazy DataFrame
over the whole tables of that directory.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catalux.fixtures import Fixtures, with_fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(slug: str, oracle: str | None = None, fixtures: tuple[str, ...] = ()):
    """Register ``fn(fx) -> DataFrame`` under ``slug`` with its oracle SQL."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Fixtures(spark, sf_dir))
        run.__name__ = f"query_{slug}"
        run.__doc__ = fn.__doc__
        if slug in QUERIES:
            raise ValueError(f"duplicate query slug {slug}")
        QUERIES[slug] = run
        if oracle is not None:
            ORACLE[slug] = with_fixtures(oracle, fixtures)
        return fn
    return deco


def load_all() -> None:
    """Import every registry module (each registers on import)."""
    from catalux.registry import (  # noqa: F401
        scans, payloads, views, filters, joins, aggregates, ranking, sets, scalars, vectors, streams, endtoend,
    )
