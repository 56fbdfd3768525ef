"""From raw documents to packed training windows, in five stages.

Toxic documents go, one document of each group of near duplicates stays, private data is replaced, sources are mixed
to their target weights, and what is left is packed. Each stage is written as Parquet and read again before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.jaccard_join import keep_first
from tidemark.llm.mixing import mix
from tidemark.llm.packing import pack
from tidemark.llm.pii import replace_private
from tidemark.llm.shared import Workspace, table
from tidemark.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold."""
    return drop_toxic(spark, docs, sf_dir)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, and all others."""
    return keep_first(spark, docs, sf_dir)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, with surrogates for private data."""
    return replace_private(spark, docs, sf_dir)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mix(Workspace(spark), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("private_data", private_data), ("mixing", mixing), ("packing", packing)]

#: A trained classifier, a similarity join and a tokenizer have no SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over the documents of sf_dir."""
    docs, ws = table(spark, sf_dir, "documents"), Workspace(spark)
    for i, (name, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return done
        docs = ws.save(done, name)
    return docs
