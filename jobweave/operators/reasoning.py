"""Models given from outside: implied skills by a language model, named entities."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import implied_prompt, parse_implied, strip
from ..functions.vocabulary import QUALIFICATION_GROUPS
from ..sources.files import exists

ENTITY = "struct<entity_group:string,word:string,score:double,start:int,end:int>"


class Client(Protocol):
    def complete(self, prompt: str) -> str: ...


def completed(prompts: DataFrame, factory: Callable[[], Client], store: str | None = None, chunks: int = 1) -> DataFrame:
    """prompt, answer for each distinct prompt; a client is made once in each worker.

    With a store, a Parquet table that grows, a prompt that it holds isn't asked
    again, in this run or a later one.  New ones are asked in ``chunks`` jobs, each
    of which leaves all its answers or none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for batch in batches:
            yield pd.DataFrame({"prompt": batch["prompt"], "answer": [client.complete(p) for p in batch["prompt"]]})

    asked = prompts.select("prompt").where("prompt is not null").distinct()
    if store is None:
        return asked.mapInPandas(run, _ANSWERS)
    spark = prompts.sparkSession
    # By digest, so that long prompts aren't sorted; equal digests are compared in full.
    digest = F.sha2("prompt", 256)
    for chunk in range(chunks):
        new = asked.where(F.pmod(F.xxhash64("prompt"), F.lit(chunks)) == chunk).withColumn("digest", digest)
        if exists(spark, store):
            known = _answers(spark, store)
            new = new.join(known.select("digest", F.col("prompt").alias("known")), (new["digest"] == known["digest"]) & (F.col("prompt") == F.col("known")), "left_anti")
        answers = new.select("prompt").mapInPandas(run, _ANSWERS)
        answers.withColumn("digest", digest).write.mode("append").parquet(store)
    return _answers(spark, store).join(asked.withColumn("digest", digest), ["digest", "prompt"], "left_semi").groupBy("prompt").agg(F.min("answer").alias("answer"))


_ANSWERS = "prompt string, answer string"


def _answers(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(f"{_ANSWERS}, digest string").parquet(store)


def implied(rows: DataFrame, factory: Callable[[], Client], text: str = "text", skills: str = "skills", store: str | None = None) -> DataFrame:
    """rows with implicit_llm: the skills that the model finds implied.  Equal prompts are asked once, with a store for good."""
    asked = rows.withColumn("_prompt", implied_prompt(F.col(text), F.col(skills)))
    answers = completed(asked.select(F.col("_prompt").alias("prompt")), factory, store)
    joined = asked.join(answers, asked["_prompt"] == answers["prompt"], "left")
    return joined.withColumn("implicit_llm", parse_implied(F.col("answer"))).drop("_prompt", "prompt", "answer")


def entities(text: Column, factory: Callable[[], Callable[[list[str]], list[list[dict]]]]) -> Column:
    """The entities that a model finds, as ``ENTITY`` structs."""

    @F.pandas_udf(f"array<{ENTITY}>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for batch in batches:
            yield pd.Series(model(batch.fillna("").tolist()))

    return found(text)


def qualifications(entities: Column) -> Column:
    """The words of entities that count as qualifications; none blank."""
    kept = F.filter(entities, lambda e: e["entity_group"].isin(*QUALIFICATION_GROUPS) & (strip(e["word"]) != ""))
    return F.transform(kept, lambda e: e["word"])
