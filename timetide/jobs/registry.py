"""Where query modules register their queries and oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from timetide.jobs.shapes import Shapes, with_shapes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a function of Shapes under a name, with DuckDB SQL over tables and shapes."""

    def register(f: Callable[[Shapes], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Shapes(spark, sf_dir))
        if oracle:
            ORACLES[name] = with_shapes(oracle)
        return f

    return register
