"""Category rules as a table, of whatever size: the first rule that matches decides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys, patterns
from ..functions.vocabulary import OTHER, UNCATEGORIZED
from .shared import checkpoint


def table(rules: DataFrame) -> DataFrame:
    """position, category, pattern: one row a pattern, from rows of position, category and patterns."""
    return rules.select("position", "category", F.explode("patterns").alias("pattern"))


def categorized(rows: DataFrame, rules: DataFrame, raw: str = "category", out: str = "normalized", empty: str = UNCATEGORIZED, other: str = OTHER) -> DataFrame:
    """rows with out: what ``normalize_category`` gives by the same rules in their order of position.

    rules: position, category, pattern.  Each distinct text is judged once: its
    keys find the patterns that may match it, those that do are compared by
    position.  ASCII patterns match as words of their own, others anywhere; null
    and empty patterns never do.
    """
    ascii_only = F.col("pattern").rlike(patterns.ASCII)
    known = rules.where("pattern is not null and pattern <> ''").groupBy("pattern").agg(F.min_by("category", "position").alias("category"), F.min("position").alias("position"))
    known = checkpoint(known.withColumn("open", ~ascii_only))
    index = keys.index(known, "pattern", F.col("pattern").rlike("[^\\x00-\\x7f]"), F.col("pattern").rlike("[^\\x00-\\x7f]")).withColumnRenamed("name", "pattern")
    index = checkpoint(index.join(keys.shuffled(known), "pattern"))
    texts = rows.select(F.col(raw).alias("_raw")).where(F.col(raw).isNotNull() & (F.col(raw) != "")).distinct()
    met = keys.meet(texts.select("_raw", F.explode(keys.text_keys(F.col("_raw"), keys.kinds_of(index))).alias("key")), index)
    word = F.concat(F.lit("(?iu)(?<![a-z0-9])"), patterns.quoted_of(F.lower("pattern")), F.lit("(?![a-z0-9])"))
    fits = F.when(F.col("open"), F.contains(F.lower("_raw"), F.lower("pattern"))).otherwise(F.rlike("_raw", word))
    first = met.where(fits).groupBy("_raw").agg(F.min_by("category", "position").alias("_category"))
    found = rows.join(first, rows[raw] == first["_raw"], "left")
    named = F.when(F.col(raw).isNull() | (F.col(raw) == ""), empty).otherwise(F.coalesce("_category", F.lit(other)))
    return found.withColumn(out, named).drop("_raw", "_category")
