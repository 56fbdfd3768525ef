"""Registration of queries, and the tables that they derive from the driver's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(f: Query) -> Query:
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def version_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a version log: key user_id, commit_ts event_id, value event_type, deleted where the type is error."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("key"), F.col("event_id").alias("commit_ts"), F.col("event_type").alias("value"), (F.col("event_type") == "error").alias("is_deleted"))


LOG_SQL = "(SELECT user_id AS key, event_id AS commit_ts, event_type AS value, event_type = 'error' AS is_deleted FROM events)"
HALF_SQL = "(SELECT max(event_id) // 2 FROM events)"


def last_event(spark: SparkSession, sf_dir: str) -> int:
    """The largest event_id: read from footers' statistics by the scan, one row."""
    return table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] or 0


def half(spark: SparkSession, sf_dir: str) -> int:
    return last_event(spark, sf_dir) // 2
