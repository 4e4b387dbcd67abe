"""Named queries over the sample tables, each with the SQL that must give the same answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register `fn(tables)`; `tables` reads the parquet folder it is given."""
    from .bindings import Tables

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap


def rnd(expr: str, digits: int) -> str:
    """SQL twin of functions.numeric.round_to."""
    scale = f"1e{digits}"
    return f"(floor(CAST({expr} AS DOUBLE) * {scale} + 0.500001) / {scale})"
