"""The generated-text signal: perplexities of sentences by a given scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ai_probability, detector_sentences

#: Makes the function that gives sentences' perplexities (NaN: none); called once in each worker.
ScorerFactory = Callable[[], Callable[[list[str]], list[float]]]


def perplexities(sentence: Column, factory: ScorerFactory) -> Column:
    """A batch of sentences goes to the model at once."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = factory()
        for batch in batches:
            yield pd.Series(score(batch.tolist()), dtype="float64")

    return scored(sentence)


def aggregated(scores: DataFrame, key: str, value: str = "perplexity") -> DataFrame:
    """key, perplexity (mean), burstiness (sample deviation, 0 of one), ai_probability; NaN and null don't count."""
    kept = scores.where(F.col(value).isNotNull() & ~F.isnan(value))
    rows = kept.groupBy(key).agg(F.avg(value).alias("perplexity"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("burstiness"))
    return rows.withColumn("ai_probability", ai_probability(F.col("perplexity"), F.col("burstiness")))


def detected(docs: DataFrame, factory: ScorerFactory, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, perplexity, burstiness, ai_probability for each document; NaN, NaN and 0 without a scored sentence."""
    sentences = docs.select(key, F.explode(detector_sentences(F.col(text))).alias("sentence"))
    found = aggregated(sentences.select(key, perplexities(F.col("sentence"), factory).alias("perplexity")), key)
    nan = F.lit(float("nan"))
    return docs.select(key).join(found, key, "left").select(key, F.coalesce("perplexity", nan).alias("perplexity"), F.coalesce("burstiness", nan).alias("burstiness"), F.coalesce("ai_probability", F.lit(0.0)).alias("ai_probability"))
