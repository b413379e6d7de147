"""The two end-to-end pipelines: implied skills of postings, audits of résumés."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import experience_years, find_keywords, union_sorted
from ..functions.vocabulary import TECH_KEYWORDS
from ..operators import audit, mining, reasoning, scoring, skills
from ..operators.ontology import Tech


def requirements(docs: DataFrame, text: str = "text", words: Iterable[str] | DataFrame = TECH_KEYWORDS, ner: Callable | None = None) -> DataFrame:
    """docs with tech_stack (by a list or a table of words), experience_years, qualifications and raw_entities."""
    none = F.array().cast(f"array<{reasoning.ENTITY}>")
    rows = skills.with_keywords(docs, words, text, out="tech_stack") if isinstance(words, DataFrame) else docs.withColumn("tech_stack", find_keywords(F.col(text), words))
    rows = rows.withColumns({"experience_years": experience_years(F.col(text)), "raw_entities": reasoning.entities(F.col(text), ner) if ner else none})
    return rows.withColumn("qualifications", reasoning.qualifications(F.col("raw_entities")))


#: docs with tech_stack and the other columns of requirements, from docs and the name of their text.
Extractor = Callable[[DataFrame, str], DataFrame]
EXPLICIT = ("tech_stack", "experience_years", "qualifications", "raw_entities")


@dataclass
class ImpliedSkills:
    """Skills that a posting implies: by rules mined from a corpus, and by a language model if given.

    extractor finds what a posting states itself; without one it is
    ``requirements`` with words and ner.  answers is a table of the model's answers
    that is kept, so that no prompt is asked twice.
    """

    words: Iterable[str] | DataFrame = TECH_KEYWORDS
    min_support: float = 0.2
    min_confidence: float = 0.6
    client: Callable[[], reasoning.Client] | None = None
    miner: Callable[[DataFrame, float, float], DataFrame] = mining.mined
    extractor: Extractor | None = None
    ner: Callable | None = None
    answers: str | None = None

    def _explicit(self, docs: DataFrame, text: str) -> DataFrame:
        return self.extractor(docs, text) if self.extractor else requirements(docs, text, self.words, self.ner)

    def rules(self, corpus: DataFrame, text: str = "text") -> DataFrame:
        """The rules of a corpus, for ``run_all``."""
        return self.miner(self._explicit(corpus, text).select(F.col("tech_stack").alias("items")), self.min_support, self.min_confidence)

    def run_all(self, targets: DataFrame, rules: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
        """targets with what each states (``EXPLICIT``), implicit_arm, implicit_llm and implicit_union.

        Rules are those of ``rules`` or some of them.  Rows of one key count as
        one target when rules are applied.
        """
        none = F.array().cast("array<string>")
        rows = self._explicit(targets, text)
        if rules is not None:
            found = mining.implied_each(rules, rows.select(F.col(key).alias("_target"), "tech_stack"), "_target", "tech_stack")
            found = found.groupBy("_target").agg(F.array_sort(F.collect_set("item")).alias("implicit_arm"))
            rows = rows.join(found, rows[key].eqNullSafe(found["_target"]), "left").drop("_target").withColumn("implicit_arm", F.coalesce("implicit_arm", none))
        else:
            rows = rows.withColumn("implicit_arm", none)
        rows = reasoning.implied(rows, self.client, text, "tech_stack", self.answers) if self.client else rows.withColumn("implicit_llm", none)
        return rows.withColumn("implicit_union", union_sorted(F.col("implicit_arm"), F.col("implicit_llm")))

    def run(self, spark: SparkSession, target: str, corpus: DataFrame | None = None, text: str = "text") -> DataFrame:
        """One row for one posting: explicit (its skills), the other columns of ``EXPLICIT``, implicit_arm, implicit_llm, implicit_union."""
        row = spark.createDataFrame([(0, target)], "doc_id int, text string")
        found = self.run_all(row, self.rules(corpus, text) if corpus is not None else None)
        return found.select(F.col("tech_stack").alias("explicit"), *EXPLICIT[1:], "implicit_arm", "implicit_llm", "implicit_union")


#: docs with violations, n_violations, suspect_spans, trust_score and trust_bucket, from docs, the name of their text and of a probability or None.
Auditor = Callable[[DataFrame, str, str | None], DataFrame]


@dataclass
class ClaimAudit:
    """Audits of texts against an ontology, with a generated-text signal if a scorer is given.

    ontology: a list of entries, or a table of them (``ontology.read``) of any
    size.  auditor takes the place of the audit by the ontology.
    """

    ontology: Sequence[Tech] | DataFrame = ()
    scorer: scoring.ScorerFactory | None = None
    key: str = "doc_id"
    auditor: Auditor | None = None

    def _audited(self, docs: DataFrame, text: str, probability: str | None) -> DataFrame:
        return self.auditor(docs, text, probability) if self.auditor else audit.report(docs, self.ontology, text, probability, self.key)

    def run(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """docs with the columns of the audit report, and with a scorer those of the signal."""
        if self.scorer is None:
            return self._audited(docs, text, None)
        signal = scoring.detected(docs, self.scorer, self.key, text).dropDuplicates([self.key])
        return self._audited(docs.join(signal, self.key, "left"), text, "ai_probability")


def sample(docs: DataFrame, n: int | None, *order: str | Column) -> DataFrame:
    """The first n rows in a stable order; all for None."""
    return docs if n is None else docs.orderBy(*order).limit(n)
