"""A skill index kept up to date: document frequencies by batch of documents.

The index is a Parquet table with a part for each batch (a file, a day, a source):
how many of its documents hold each skill, and under a null skill how many there
are.  Counts add up over batches, so a batch that comes again replaces its own part
and nothing else is read; a batch of which no document is left is dropped.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.vocabulary import TECH_KEYWORDS
from ..sources.files import exists
from . import skills

_PARTS = "skill string, n long, batch string"


def update(docs: DataFrame, path: str, words: Iterable[str] | DataFrame = TECH_KEYWORDS, batch: str = "batch", text: str = "text") -> None:
    """Put the batches of docs (column ``batch``) into the index, each in place of what it held before.

    Blank texts count neither as documents nor for skills, but their batch is
    replaced.  A null batch is one of its own.
    """
    rows = docs.withColumn("batch", F.col(batch).cast("string"))
    counts = skills.document_frequency(rows, words, text, ("batch",)).select("skill", F.col("doc_count").alias("n"), "batch")
    totals = rows.groupBy("batch").agg(F.count_if(F.coalesce(F.col(text).rlike(skills.NON_BLANK), F.lit(False))).alias("n")).select(F.lit(None).cast("string").alias("skill"), "n", "batch")
    _put(counts.unionByName(totals), path)


def _put(parts: DataFrame, path: str) -> None:
    parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def drop(spark: SparkSession, path: str, batch: str) -> None:
    """Take a batch out of the index: its part becomes one of no documents."""
    _put(spark.createDataFrame([(None, 0, batch)], _PARTS), path)


def _parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_PARTS).parquet(path)


def frequency(spark: SparkSession, path: str) -> DataFrame:
    """skill, doc_count over all batches; no rows if there is no index."""
    if not exists(spark, path):
        return spark.createDataFrame([], "skill string, doc_count long")
    return _parts(spark, path).where("skill is not null").groupBy("skill").agg(F.sum("n").alias("doc_count"))


def total(spark: SparkSession, path: str) -> DataFrame:
    """total_docs, one row, over all batches."""
    if not exists(spark, path):
        return spark.createDataFrame([(0,)], "total_docs long")
    return _parts(spark, path).where("skill is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_docs"))


def follow(docs: DataFrame, path: str, checkpoint: str, words: Iterable[str] | DataFrame = TECH_KEYWORDS, batch: str = "batch", text: str = "text") -> StreamingQuery:
    """Keep the index up to date with a stream of documents, as far as it has come.

    All documents of a batch have to come in one micro-batch, as the rows of a
    file do.  A micro-batch that is run again leaves the same index.
    """
    put = lambda rows, _: update(rows, path, words, batch, text)
    return docs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
