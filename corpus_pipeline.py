"""Five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents.  ``run`` writes each stage's rows to the shared
folder and reads them again for the next, so a lost executor costs one stage's
tasks at most.

A null text counts as blank: such a document passes the stages that judge texts,
near-dedup keeps one of all blank ones, and encoding gives it no ids.  Null ids
come first among ids.  Rows that repeat a doc_id and its text are one document
from line dedup on.  Of copies and near copies the least doc_id stays, which
settles ties.  Texts are judged, compared and encoded whole, however long.
Without labels of both kinds nothing is toxic by contrast (``toxicity``); empty
tables give no rows.  Further columns pass through to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from jobweave.llm import bpe, decontaminate, linededup, neardup, toxicity
from jobweave.llm.common import scratch, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below 0.5; learns from labels that aren't held out."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each component of near lines stays; documents left without a line go."""
    return linededup.remaining(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word Jaccard likeness 0.8 or more stays: the exact half of ``simhash_dedup``."""
    return neardup.representatives(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, of operator 6's SimHash links and those of ``near_dedup`` together."""
    return neardup.representatives(docs, by_prints=True)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and digests of the ids and of what they decode to."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.digests(docs, ranks, public_tokenizers.PATTERN, with_ids=True)


STAGES = [("toxicity", toxic), ("line_dedup", line_dedup), ("simhash", simhash_dedup), ("decontamination", decontamination), ("bpe", encode)]

#: SQL can't express the stages; tests hold them against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over all documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
