"""Replication of a change log: a file stream that is applied batch by batch and resumes where it stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import versions as V

SCHEMA = "seq long, op string, key string, val string"


def replicate(spark: SparkSession, log_dir: str, replica_dir: str, checkpoint_dir: str, after: int = -1, available_now: bool = True) -> StreamingQuery:
    """Streams entries with seq > after from Parquet files in log_dir to replica_dir.

    A batch is written to a folder of its own number and replaces what a failed attempt left there, so a batch that
    is run again has no effect; the checkpoint keeps the place in the log over restarts.
    """
    entries = spark.readStream.schema(SCHEMA).parquet(log_dir).where(f"seq > {int(after)}")

    def apply(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(["seq"]).write.mode("overwrite").parquet(f"{replica_dir}/batch={number}")

    writer = entries.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint_dir)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def applied(spark: SparkSession, replica_dir: str) -> DataFrame:
    """The replica's entries, each seq once, even if the primary sent it in several batches."""
    return spark.read.schema(f"{SCHEMA}, batch int").parquet(replica_dir).drop("batch").dropDuplicates(["seq"])


def state(spark: SparkSession, replica_dir: str) -> DataFrame:
    """Live (key, value) of the replica."""
    return V.replay(applied(spark, replica_dir))
