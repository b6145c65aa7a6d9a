"""Every query by name, and the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scholia.adapters import Source, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a function of a Source under a name, with its oracle over the adapter views."""

    def add(f: Callable[[Source], DataFrame]) -> Callable[[Source], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Source(spark, sf_dir))
        if oracle:
            ORACLES[name] = sql(oracle)
        return f

    return add


def load() -> None:
    """Import the modules that hold queries."""
    from scholia.plans import corpus, linking, practice, recovery, retrieval, scalars, stats, wrong_import  # noqa: F401
    from scholia.streaming import events, queue  # noqa: F401
