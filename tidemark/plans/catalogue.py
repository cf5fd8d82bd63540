"""All queries of the engine, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ..ship import ship
from . import filed, ingests, notices, relational, replays, rules, scored, series, texts


def _shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run


MODULES = (scored, relational, series, texts, ingests, filed, rules, notices, replays)
QUERIES = {name: _shipped(f) for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
