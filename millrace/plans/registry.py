"""The catalogue of queries, each with the SQL that gives the same result elsewhere."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.session import configure, scratch_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given tables of one folder, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = configure(spark)
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        # Kept, so that the footer of a table is read once per query.
        frame = self.__dict__[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return frame

    def scratch(self, label: str) -> str:
        return scratch_path(self.spark, label)


def query(name: str, sql: str | None = None):
    """Register ``function(tables)`` under ``name`` with its SQL."""

    def register(function: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"Query {name} is registered twice.")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return function(Tables(spark, folder))

        run.__doc__ = function.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return function

    return register
