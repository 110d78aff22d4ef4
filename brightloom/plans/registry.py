"""Registered queries: a function over the driver's tables, and SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brightloom.plans.derived import table, with_views
from brightloom.session import ensure_settings
from brightloom.sources.tables import portable


class Tables:
    """The driver's tables and the views derived from them, by name."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = ensure_settings(spark)
        self.root = root

    def __call__(self, name: str) -> DataFrame:
        return table(self.spark, self.root, name)

    def rows(self, values: list[tuple], schema: str) -> DataFrame:
        """A small configuration table."""
        return self.spark.createDataFrame(values, schema)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a query under its function's name, with the oracle over the named views."""

    def register(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, root: str) -> DataFrame:
            return portable(build(Tables(spark, root)))

        run.__doc__ = build.__doc__
        QUERIES[build.__name__] = run
        if sql is not None:
            ORACLES[build.__name__] = with_views(list(views), sql)
        return build

    return register
