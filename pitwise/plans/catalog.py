"""Registry of query keys: Spark builder + DuckDB oracle SQL per key.

Builders take ``(spark, sf_dir)`` and return a DataFrame; oracles are
DuckDB SQL over the driver's pre-registered table views (fixture CTEs are
prepended by ``oracle_views.with_views``).  Every double in a result is
rounded to 6 decimals in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pitwise.plans.oracle_views import with_views

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query key {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return fn

    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from pitwise.plans import (  # noqa: F401
        q_news, q_calendar, q_statements, q_estimates, q_responses, q_portfolio, q_scoring, q_sources,
    )
