"""Registry of queries: a Spark builder per operator and, where SQL can say it, the same result as SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from claimweave.session import ship_package

Builder = Callable[["Tables"], DataFrame]

BUILDERS: dict[str, Builder] = {}
SQL: dict[str, str] = {}
COVERS: dict[str, str] = {}


class Tables:
    """The driver tables of one folder, read lazily with only the columns a plan needs."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, covers: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    def register(fn: Builder) -> Builder:
        if name in BUILDERS:
            raise ValueError(f"query {name} is registered twice")
        BUILDERS[name], COVERS[name] = fn, covers
        if sql is not None:
            SQL[name] = sql.strip()
        return fn

    return register


def as_callable(fn: Builder) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return fn(Tables(spark, folder))

    return run
