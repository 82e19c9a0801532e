"""How queries are registered."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession, rows: int = 500) -> None:
    """Pages go to Python in batches of so many rows at most, unless the session asks for fewer: both sides hold a batch, several times over while it is converted."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir for what a query writes and reads back; where that is unset, on this machine, if all of Spark runs on it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{tempfile.mkdtemp()}"
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Book:
    """Queries of a module, and their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
        def put(query: Query) -> Query:
            self.queries[name or query.__name__] = query
            if sql:
                self.oracles[name or query.__name__] = sql
            return query

        return put

    def on(self, source: str, name: str, build: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
        """A query over one table."""
        self.add(sql, name)(lambda spark, sf_dir: build(table(spark, sf_dir, source)))
