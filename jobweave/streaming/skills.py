"""Skills of postings as they arrive.

The skill operators are expressions over one row, so they serve a stream as they
serve a table.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import posting_skills
from ..functions.vocabulary import TECH_KEYWORDS
from ..sources import schemas
from ..sources.files import posting_text


def posting_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """New JSON-lines files of postings in a folder."""
    return spark.readStream.schema(schemas.POSTING).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def with_skills(postings: DataFrame, words: Iterable[str] = TECH_KEYWORDS) -> DataFrame:
    return postings.withColumn("items", posting_skills(posting_text(postings), F.col("skills"), words))


def append(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet, each row once, and stop when what is there has been read."""
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
