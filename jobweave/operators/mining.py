"""Frequent itemsets and association rules.

Itemsets come from parallel FP-growth.  Its own rules have single consequents,
so rules are grown from the itemsets: consequents of one item first, then larger
ones of those that are confident enough, each level one equality join with the
itemsets' supports.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark import StorageLevel
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpoint

_ITEMSETS = "items array<string>, freq long, support double"


def itemsets(baskets: DataFrame, min_support: float = 0.2, items: str = "items") -> DataFrame:
    """items (sorted), freq, support of all itemsets with at least this support.

    Empty baskets count in the denominator; repeats within a basket don't.
    """
    # Kept for the count and the two passes of the fit; a lost part is computed again.
    rows = baskets.select(F.array_sort(F.array_distinct(F.coalesce(items, F.array().cast("array<string>")))).alias("items")).persist(StorageLevel.MEMORY_AND_DISK)
    total = rows.count()
    if not total:
        rows.unpersist()
        return baskets.sparkSession.createDataFrame([], _ITEMSETS)
    # Slightly below the threshold, since FP-growth rounds it up; the exact test follows.
    model = FPGrowth(itemsCol="items", minSupport=max(0.0, min_support - 0.5 / total), minConfidence=1.0).fit(rows)
    rows.unpersist()
    support = F.col("freq") / F.lit(total)
    return model.freqItemsets.select(F.array_sort("items").alias("items"), "freq", support.alias("support")).where(support >= min_support)


def rules(itemsets: DataFrame, min_confidence: float = 0.6) -> DataFrame:
    """antecedent, consequent, support, confidence, lift of all rules with at least this confidence.

    Moving an item from antecedent to consequent never raises the confidence, so
    a consequent is grown only from one that suffices, by a later item of its
    itemset.  Each is reached once, and levels end when none suffices.
    """
    known = itemsets.select("items", "support")
    of = known.select(F.col("items").alias("antecedent"), F.col("support").alias("antecedent_support"))
    grown = known.where(F.size("items") > 1).select("support", F.array().cast("array<string>").alias("consequent"), F.col("items").alias("antecedent"))
    levels = []
    while True:
        # One item more, in the order of the items; an antecedent of one item stays.
        later = F.filter("antecedent", lambda x: F.coalesce(x > F.try_element_at("consequent", F.lit(-1)), F.lit(True)))
        more = grown.where(F.size("antecedent") > 1).select("support", "consequent", "antecedent", F.explode(later).alias("item"))
        more = more.select("support", F.concat("consequent", F.array("item")).alias("consequent"), F.array_remove("antecedent", F.col("item")).alias("antecedent"))
        grown = more.join(of, "antecedent").withColumn("confidence", F.col("support") / F.col("antecedent_support")).where(F.col("confidence") >= min_confidence)
        grown = checkpoint(grown)
        if grown.isEmpty():
            break
        levels.append(grown)
    found = reduce(DataFrame.unionByName, levels or [grown])
    then = known.select(F.col("items").alias("consequent"), F.col("support").alias("consequent_support"))
    return found.join(then, "consequent").select("antecedent", "consequent", "support", "confidence", (F.col("support") / (F.col("antecedent_support") * F.col("consequent_support"))).alias("lift"))


def mined(baskets: DataFrame, min_support: float = 0.2, min_confidence: float = 0.6, items: str = "items") -> DataFrame:
    return rules(itemsets(baskets, min_support, items), min_confidence)


def top_rules(rules: DataFrame, n: int = 20) -> DataFrame:
    """The n rules of highest confidence, then lift; ties by antecedent and consequent."""
    return rules.orderBy(F.desc("confidence"), F.desc("lift"), "antecedent", "consequent").limit(n)


def applicable(rules: DataFrame, target: Iterable[str]) -> DataFrame:
    """Rules whose antecedent lies within the target."""
    known = F.array(*map(F.lit, target)).cast("array<string>")
    return rules.where(F.size(F.array_except("antecedent", known)) == 0)


def implied(rules: DataFrame, target: Iterable[str]) -> DataFrame:
    """item: what applicable rules add to the target, sorted.  Distinct items only are shuffled."""
    target = list(target)
    known = F.array(*map(F.lit, target)).cast("array<string>")
    return applicable(rules, target).select(F.explode(F.array_except("consequent", known)).alias("item")).distinct().orderBy("item")


def implied_each(rules: DataFrame, targets: DataFrame, key: str, items: str = "items") -> DataFrame:
    """key, item: what the rules add to each target's items, for all targets at once.

    A rule is tried only on targets that have its antecedent's rarest item: one
    equality join, and a test of the whole antecedent on what it finds.  Rules of
    equal antecedent are one, with all their consequents.  A rule without an
    antecedent applies to every target.  Neither rules nor targets pass through
    the driver.  Repeated keys, null included, are one target with the items of
    all their rows; null items don't count.
    """
    none = F.array().cast("array<string>")
    asked = targets.select(F.col(key).alias("_key"), F.explode_outer(F.array_compact(F.coalesce(items, none))).alias("item"))
    asked = asked.groupBy("_key").agg(F.collect_set("item").alias("have"))
    # Antecedents are compared as arrays: a hash of arrays doesn't tell ['a'], ['b', 'c'] from ['a', 'b'], ['c'].
    known = rules.select(F.array_sort(F.array_distinct("antecedent")).alias("antecedent"), F.explode("consequent").alias("item")).groupBy("antecedent").agg(F.collect_set("item").alias("adds"))
    always = known.where(F.size("antecedent") == 0).select("adds")
    common = asked.select(F.explode("have").alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    # An item that no target has drops its rules here.
    parts = known.where(F.size("antecedent") > 0).select("antecedent", "adds", F.explode("antecedent").alias("item")).join(common, "item", "left")
    rarest = parts.groupBy("antecedent").agg(F.min_by("item", F.struct(F.coalesce("n", F.lit(0)), "item")).alias("item"), F.first("adds").alias("adds"))
    tried = asked.select("_key", "have", F.explode("have").alias("item")).join(rarest, "item").where(F.size(F.array_except("antecedent", "have")) == 0)
    added = tried.select("_key", F.explode(F.array_except("adds", "have")).alias("item"))
    free = asked.select("_key", F.explode(F.array_except(F.coalesce(always.scalar(), none), "have")).alias("item"))
    return added.unionByName(free).distinct().select(F.col("_key").alias(key), "item")
