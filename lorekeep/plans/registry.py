"""Registry of the queries that run on the shared tables, each with its plain-SQL counterpart where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


TEXT_KEYS = {"documents": "doc_id", "pages": "page_id"}


class Tables:
    """The shared tables of one folder, read lazily: `t.documents`."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        key = TEXT_KEYS.get(name)
        # A text table that arrives as one small file would be worked on by one task; larger inputs keep their splits.
        if key and rows.rdd.getNumPartitions() < self.spark.sparkContext.defaultParallelism:
            return rows.repartition(self.spark.sparkContext.defaultParallelism, key)
        return rows


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def sql_list(values) -> str:
    """Values as a SQL list of text literals."""
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)
