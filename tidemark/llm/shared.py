"""Storage shared by executors, and connected components over tables of links."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import shared_folder


#: Bytes that Spark hands to Python at once. Such batches lie outside of the heap, in several copies on both sides.
ARROW_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: object) -> DataFrame:
    """df.mapInArrow in batches of about ARROW_BYTES; a task gives back what its allocators hold when it ends.

    Without the bound a batch has up to 10,000 rows, however long their texts are. It is a setting of the session,
    read when a plan runs, so it stays lowered; a lower one stays as it is.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    bytes_of = df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if not 0 < bytes_of(conf.get(name)) <= ARROW_BYTES:
        conf.set(name, str(ARROW_BYTES))

    def frugal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(frugal, schema)


def give_back() -> None:
    """Returns freed memory to the system: a worker serves tasks of many kinds, one after the other."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class Workspace:
    """Tables written under the shared folder: they cut lineage and survive the loss of an executor.

    The files go when the driver's JVM ends, or earlier by drop().
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_folder(spark)}/tidemark-{uuid.uuid4().hex}"
        self._n = 0
        path = self._path(self.root)
        self._fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(path)

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tidemark_path = path
        return out

    def hinted(self, df: DataFrame, row_bytes: int = 32, most_mb: int = 32) -> DataFrame:
        """A saved table of few columns, with a broadcast hint if its counted rows are under most_mb; else as it is."""
        return F.broadcast(df) if df.count() * row_bytes <= most_mb << 20 else df

    def tidy(self) -> None:
        """Lets Spark remove the shuffle files of plans that nothing refers to any more."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, df: DataFrame) -> None:
        self._fs.delete(self._path(df._tidemark_path), True)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few texts at a time are Python objects."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def collapse(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links (a, b) and, for each, the smallest node that it reaches."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        new = new[label]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        nodes, roots = collapse(pdf["a"].to_numpy(np.int64), pdf["b"].to_numpy(np.int64))
        keep = nodes != roots
        yield pd.DataFrame({"a": nodes[keep], "b": roots[keep]})


def components(ws: Workspace, links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b: long); component is the smallest node that it reaches.

    Each batch of links first becomes a forest of stars, in its task. Then rounds: every node points at its
    smallest neighbour, pointers are followed to their ends by doubling, and links are rewritten to the ends;
    each round at least halves the nodes that still have links. State lies in shared tables, so a lost executor
    costs a task, not a round. A node with very many links is only ever a join key of two plain exchanges, which
    adaptive execution splits, or a key of a partial minimum.
    """
    forest = links.select("a", "b").where("a <> b").mapInPandas(_forest, "a long, b long")
    edges = ws.save(forest.distinct(), "links")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = ws.save(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("up")), "up")
        while True:
            above = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = ws.save(up.join(above, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "jumped")
            up, moved = jumped.select("node", "up"), not jumped.where("moved").isEmpty()
            if not moved:
                break
        at = lambda c, n: up.select(F.col("node").alias(c), F.col("up").alias(n))
        rewritten = edges.join(at("a", "x"), "a").join(at("b", "y"), "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        edges = ws.save(rewritten, "links")
        if labels is None:
            labels = up.select("node", F.col("up").alias("component"))
        else:
            labels = labels.join(at("component", "top"), "component", "left").select("node", F.coalesce("top", "component").alias("component"))
        labels = ws.save(labels, "labels")
    if labels is None:
        return ws.spark.createDataFrame([], "node long, component long")
    return labels
