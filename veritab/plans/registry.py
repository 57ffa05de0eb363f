"""Registry of named queries and the SQL each is checked against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veritab.session import cut_lineage, ensure_checkpoint_dir, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazy access to the parquet tables of one directory: ``t.lineitem``."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory.rstrip("/")
        self._memo: dict[str, DataFrame] = {}

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A small derived table (assignments, fits) written once and shared by the query."""
        if name not in self._memo:
            self._memo[name] = cut_lineage(build())
        return self._memo[name]

    def path(self, name: str) -> str:
        return f"{self.directory}/{name}.parquet"

    def scratch(self, name: str) -> str:
        """A fresh path in the shared checkpoint folder, for queries that go through a file format."""
        return f"{ensure_checkpoint_dir(self.spark)}/scratch/{name}-{uuid.uuid4().hex}"

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        key = f"table:{name}"
        if key not in self._memo:
            self._memo[key] = spread(self.spark.read.parquet(self.path(name)))
        return self._memo[key]


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its oracle SQL."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap
