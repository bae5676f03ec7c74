"""Query registry."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recordflow.schemas import INPUT_DDL
from recordflow.session import tune
from recordflow.sources.tables import scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The input tables of one folder as attributes, each set up when first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in INPUT_DDL:
            raise AttributeError(name)
        table = scan(self.spark, self.folder, name)
        setattr(self, name, table)
        return table

    def some(self, names) -> dict[str, DataFrame]:
        """Several tables by name."""
        return {name: getattr(self, name) for name in names}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under a name, with its SQL counterpart if there is one."""

    def add(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(tune(spark), folder))

        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
