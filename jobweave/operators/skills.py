"""Skills over a corpus: document frequency, recall, transactions.

A list of words is compiled into one pattern.  A table of words, of whatever
size, is met by an index of keys (``functions.keys``) instead, and each text is
searched for the few words whose keys it has.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys, patterns
from ..functions.text import find_keywords, normalize_category, or_empty, posting_skills, skills_united, strip
from ..functions.vocabulary import IT_CATEGORIES, TECH_KEYWORDS
from ..sources.files import posting_text
from .shared import checkpoint


#: A text that isn't blank.
NON_BLANK = r"(?U)[^\s\x1c-\x1f]"


def with_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose text isn't blank."""
    return docs.where(F.col(text).rlike(NON_BLANK))


def with_keywords(docs: DataFrame, words: DataFrame, text: str = "text", word: str = "word", out: str = "skills") -> DataFrame:
    """docs with out: what ``find_keywords`` finds by a table of words.

    A word can only match where its key is, so the pattern of a text's own
    candidates matches what the pattern of all words would, the longest word
    first.  Candidates are gathered by the text's hash, once for equal texts; texts
    of one hash would share them, which changes nothing.  Where all candidates are
    runs of ASCII letters and digits, and the text is ASCII, they are found as keys.
    """
    known = words.where(F.col(word).isNotNull() & (F.col(word) != "")).select(F.lower(word).alias("name")).distinct()
    index = checkpoint(keys.index(known))
    tokens = docs.select(F.xxhash64(text).alias("_key"), F.explode(keys.text_keys(F.col(text), keys.kinds_of(index))).alias("key"))
    ranked = F.array_sort(F.collect_set(F.struct((-F.length("name")).alias("n"), F.col("name"))))
    candidates = keys.meet(tokens, index).groupBy("_key").agg(ranked.alias("_ranked"))
    any_of = F.array_join(F.transform("_ranked", lambda w: patterns.quoted_of(w["name"])), "|")
    pattern = F.concat(F.lit("(?iu)(?<![a-zA-Z0-9])("), any_of, F.lit(")(?![a-zA-Z0-9])"))
    rows = docs.join(candidates, F.xxhash64(docs[text]) == F.col("_key"), "left")
    hits = F.regexp_extract_all(or_empty(F.col(text)), F.coalesce(pattern, F.lit(f"({patterns.NEVER})")), 1)
    names = F.transform("_ranked", lambda w: w["name"])
    plain = (F.octet_length(text) == F.length(text)) & F.forall(names, lambda n: n.rlike(r"\A[a-z0-9]+\z"))
    found = F.when(F.col("_ranked").isNull(), F.array().cast("array<string>")).when(plain, F.array_sort(F.array_intersect(keys.text_keys(F.col(text)), names)))
    return rows.withColumn(out, found.otherwise(F.array_sort(F.array_distinct(F.transform(hits, F.lower))))).drop("_key", "_ranked")


def document_frequency(docs: DataFrame, words: Iterable[str] | DataFrame = TECH_KEYWORDS, text: str = "text", by: tuple[str, ...] = ()) -> DataFrame:
    """(by,) skill, doc_count: how many texts hold each skill.  words: a list, or a table (column word).

    With a list, one shuffle, of partial counts.
    """
    rows = with_text(docs, text)
    if isinstance(words, DataFrame):
        found = with_keywords(rows.select(*by, text), words, text, out="_found").select(*by, F.explode("_found").alias("skill"))
    else:
        found = rows.select(*by, F.explode(find_keywords(F.col(text), words)).alias("skill"))
    return found.groupBy(*by, "skill").agg(F.count("*").alias("doc_count"))


def total_documents(docs: DataFrame, text: str = "text", by: tuple[str, ...] = ()) -> DataFrame:
    """(by,) total_docs: how many texts aren't blank."""
    return with_text(docs, text).groupBy(*by).agg(F.count("*").alias("total_docs"))


def top(frequency: DataFrame, k: int = 30) -> DataFrame:
    """The k most frequent skills; ties in the skills' order."""
    return frequency.orderBy(F.desc("doc_count"), "skill").limit(k)


def frequencies(skills: DataFrame, frequency: DataFrame, total: DataFrame) -> DataFrame:
    """skills (column skill) with frequency: the share of documents that hold it, 0 if none.

    Names are compared in small letters.  total is one row.
    """
    known = frequency.select(F.col("skill").alias("_skill"), "doc_count")
    asked = skills.join(known, F.lower(skills["skill"]) == known["_skill"], "left").drop("_skill")
    asked = asked.withColumn("_total", total.select("total_docs").scalar())
    share = F.when(F.col("_total") > 0, F.coalesce("doc_count", F.lit(0)) / F.col("_total")).otherwise(0.0)
    return asked.withColumn("frequency", share).drop("doc_count", "_total")


def recall_proxy(skills: DataFrame, frequency: DataFrame, total: DataFrame, least: float = 0.005) -> DataFrame:
    """One row, recall: the share of the skills that are at least so frequent; 0 without skills.

    Null and empty skills don't count, repeats do.
    """
    asked = frequencies(skills.where("skill is not null and skill <> ''"), frequency, total)
    return asked.agg(F.coalesce(F.avg((F.col("frequency") >= least).cast("double")), F.lit(0.0)).alias("recall"))


def is_it(category: Column, title: Column) -> Column:
    """Whether either names a job in technology or research."""
    return normalize_category(category).isin(*IT_CATEGORIES) | normalize_category(title).isin(*IT_CATEGORIES)


def with_items(postings: DataFrame, words: Iterable[str] | DataFrame = TECH_KEYWORDS, align: bool = False) -> DataFrame:
    """postings with items: keywords of their text, by a list or a table of words, united with their normalised tags."""
    if not isinstance(words, DataFrame):
        return postings.withColumn("items", posting_skills(posting_text(postings), F.col("skills"), words, align=align))
    rows = with_keywords(postings.withColumn("_text", posting_text(postings)), words, "_text", out="_found")
    return rows.withColumn("items", skills_united(F.col("_found"), F.col("skills"), align=align)).drop("_text", "_found")


def transactions(postings: DataFrame, least: int = 2, it_only: bool = False, words: Iterable[str] | DataFrame = TECH_KEYWORDS, align: bool = False) -> DataFrame:
    """items: the skills of each posting that has at least so many."""
    rows = postings.where(is_it(F.col("category"), F.col("job_title"))) if it_only else postings
    return with_items(rows, words, align).select("items").where(F.size("items") >= least)


def item_counts(baskets: DataFrame, items: str = "items") -> DataFrame:
    """item, n, share: how many baskets hold each item, and of all baskets what share."""
    counts = baskets.select(F.explode(F.array_distinct(items)).alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    total = baskets.agg(F.count("*")).scalar()
    return counts.select("item", "n", (F.col("n") / total).alias("share"))


def non_blank(text: Column) -> Column:
    return strip(text) != ""
