"""Claims in résumés against the ontology's release years.

With a list of technologies a document is judged within its row: sentences, years,
matching entries and versions are array expressions, so an audit needs no shuffle
and no join, but its plan grows with the list.  With a table of technologies,
of whatever size, the sentences that name a year meet the entries by an index of
keys (``functions.keys``), and patterns run on the pairs so found.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys, patterns
from ..functions.text import audit_sentences, claim_years, trust_bucket, trust_score, version_tokens
from .ontology import Tech
from .shared import checkpoint

VIOLATION = "struct<sentence_no:int,tech:string,claimed_year:int,actual_year:int,snippet:string,kind:string,message:string>"


_ENTRY = "struct<name:string,year:int,versions:map<string,int>>"


def _said(subject: Column, actual: Column, verb: str, claimed: Column) -> Column:
    # Fixed value: the wording of messages.
    return F.concat(subject, F.lit("는 "), actual.cast("string"), F.lit(f"년에 {verb}되었으나 문장은 "), claimed.cast("string"), F.lit("년을 주장합니다."))


def _violation(s: Column, tech: Column, actual: Column, kind: str, message: Column) -> Column:
    return F.struct(s["no"].cast("int").alias("sentence_no"), tech.alias("tech"), s["claimed"].cast("int").alias("claimed_year"), actual.cast("int").alias("actual_year"), s["text"].alias("snippet"), F.lit(kind).alias("kind"), message.alias("message"))


def _judged(s: Column, entry: Column) -> Column:
    """The violations of one entry in one sentence: release first, then versions as they come."""
    name, year, claimed = entry["name"], entry["year"], s["claimed"]
    release = F.array(F.when(claimed < year, _violation(s, name, year, "release_year", _said(name, year, "공개", claimed))))

    def of(version: Column) -> Column:
        known = F.coalesce(F.try_element_at(entry["versions"], version), F.try_element_at(entry["versions"], F.split_part(version, F.lit("."), F.lit(1))))
        return F.when(claimed < known, _violation(s, name, known, "version_year", _said(F.concat(name, F.lit(" "), version), known, "출시", claimed)))

    return F.filter(F.concat(release, F.transform(s["versions"], of)), lambda v: v.isNotNull())


def _named(s: Column, ontology: Sequence[Tech]) -> Column:
    """Places in the ontology of the entries that a sentence names.

    A search for the plain name comes before its pattern, as most sentences name few entries.
    """
    found = []
    for i, tech in enumerate(ontology):
        names = [n for n in (tech.name, *tech.aliases) if n]
        if not names:
            continue
        there = s["low"].contains(keys.folded(names[0]))
        for n in names[1:]:
            there = there | s["low"].contains(keys.folded(n))
        found.append(F.when(there & s["text"].rlike(patterns.any_name(names)), F.lit(i)))
    return F.filter(F.array(*found), lambda i: i.isNotNull())


def violations_of(text: Column, ontology: Sequence[Tech]) -> Column:
    """All violations of a text, in order of sentence, ontology, kind and version."""
    known: dict[str, Tech] = {}
    for tech in ontology:  # one entry a name
        known.setdefault(tech.name, tech)
    if not any(n for t in known.values() for n in (t.name, *t.aliases)):
        return F.array().cast(f"array<{VIOLATION}>")
    table = F.from_json(F.lit(json.dumps([{"name": t.name, "year": t.released_year, "versions": t.versions} for t in known.values()], ensure_ascii=False)), f"array<{_ENTRY}>")

    # Each step binds what the next one reads, so no pattern runs twice on a sentence.
    # Years first: only sentences with a year meet the entries.
    dated = F.transform(audit_sentences(text), lambda s, n: F.struct(n.alias("no"), s.alias("text"), claim_years(s).alias("years")))
    low = F.transform(F.filter(dated, lambda s: F.size(s["years"]) > 0), lambda s: F.struct(s["no"].alias("no"), s["text"].alias("text"), F.array_min(s["years"]).alias("claimed"), keys.fold(s["text"]).alias("low")))
    named = F.transform(low, lambda s: F.struct(s["no"].alias("no"), s["text"].alias("text"), s["claimed"].alias("claimed"), _named(s, list(known.values())).alias("entries")))
    ready = F.transform(F.filter(named, lambda s: F.size(s["entries"]) > 0), lambda s: F.struct(s["no"].alias("no"), s["text"].alias("text"), s["claimed"].alias("claimed"), s["entries"].alias("entries"), version_tokens(s["text"]).alias("versions")))
    return F.flatten(F.transform(ready, lambda s: F.flatten(F.transform(s["entries"], lambda i: _judged(s, F.get(table, i))))))


def _dated(text: Column) -> Column:
    """The sentences that have a year: no, text, claimed (their first year in time)."""
    each = F.transform(audit_sentences(text), lambda s, n: F.struct(n.alias("no"), s.alias("text"), F.array_min(claim_years(s)).alias("claimed")))
    return F.filter(each, lambda s: s["claimed"].isNotNull())


def _names(ontology: DataFrame) -> DataFrame:
    """name_text, pattern, order, entry: each name and alias of the entries, of which the first counts for each name."""
    entry = F.struct("name", F.col("released_year").alias("year"), "versions").alias("entry")
    first = ontology.groupBy("name").agg(F.min_by(F.struct(F.col("position").alias("order"), entry, "aliases"), "position").alias("e")).select("e.*")
    aliases = F.coalesce("aliases", F.array().cast("array<string>"))
    names = first.select("order", "entry", F.explode(F.array_distinct(F.concat(F.array("entry.name"), aliases))).alias("name_text")).where("name_text <> ''")
    return names.withColumn("pattern", patterns.name_of(F.col("name_text")))


def indexed_violations(docs: DataFrame, ontology: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, position, and the fields of each violation, for a table of technologies (``ontology.read``).

    The same rows as ``violations`` gives for the table's entries, if keys don't
    repeat.  The keys of sentences with a year meet one key a name, the rarest; names
    and sentences so met are compared by the name's characters, then its pattern.
    Only what may be met is shuffled, with its sentence.
    """
    sentences = docs.select(F.col(key).alias("_key"), F.explode(_dated(F.col(text))).alias("s")).select("_key", "s.*")
    sentences = sentences.withColumn("id", F.monotonically_increasing_id())
    names = checkpoint(_names(ontology))
    index = keys.index(names, "name_text", open_end=~F.col("name_text").rlike(patterns.ASCII)).withColumnRenamed("name", "name_text")
    index = checkpoint(index.join(keys.shuffled(names), "name_text").withColumn("low", keys.fold(F.col("name_text"))))
    tokens = sentences.withColumn("key", F.explode(keys.text_keys(F.col("text"), keys.kinds_of(index))))
    named = keys.meet(tokens, index).where(F.contains(keys.fold(F.col("text")), F.col("low"))).where(F.rlike("text", F.col("pattern")))
    said = F.struct("no", "text", "claimed", version_tokens(F.col("text")).alias("versions"))
    found = named.select("_key", "id", "no", "order", said.alias("s"), "entry").select("_key", "id", "no", "order", F.posexplode(_judged(F.col("s"), F.col("entry"))).alias("n", "v"))
    # An entry that several of its names, or keys, find in a sentence counts once.
    each = found.groupBy("_key").agg(F.array_sort(F.array_distinct(F.collect_list(F.struct("no", "order", "n", "id", "v")))).alias("all"))
    return each.select(F.col("_key").alias(key), F.posexplode("all").alias("position", "f")).select(key, "position", "f.v.*")


def violations(docs: DataFrame, ontology: Sequence[Tech] | DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, position, and the fields of each violation."""
    if isinstance(ontology, DataFrame):
        return indexed_violations(docs, ontology, key, text)
    return docs.select(key, F.posexplode(violations_of(F.col(text), ontology)).alias("position", "v")).select(key, "position", "v.*")


def report(docs: DataFrame, ontology: Sequence[Tech] | DataFrame, text: str = "text", probability: str | None = None, key: str = "doc_id") -> DataFrame:
    """docs with violations, n_violations, suspect_spans, trust_score and trust_bucket.

    With a table of technologies, key names the documents, each once.
    """
    if isinstance(ontology, DataFrame):
        fields = [f.split(":")[0] for f in VIOLATION[len("struct<") : -1].split(",")]
        found = indexed_violations(docs, ontology, key, text).select(F.col(key).alias("_key"), F.struct("position", F.struct(*fields).alias("v")).alias("p"))
        found = found.groupBy("_key").agg(F.array_sort(F.collect_list("p")).alias("_all"))
        rows = docs.join(found, docs[key].eqNullSafe(F.col("_key")), "left").withColumn("violations", F.coalesce("_all.v", F.array().cast(f"array<{VIOLATION}>"))).drop("_key", "_all")
    else:
        rows = docs.withColumn("violations", violations_of(F.col(text), ontology))
    count = F.size("violations")
    score = trust_score(count, F.col(probability) if probability else None)
    return rows.withColumns({"n_violations": count, "suspect_spans": F.array_sort(F.array_distinct(F.transform("violations", lambda v: v["snippet"]))), "trust_score": score, "trust_bucket": trust_bucket(score)})


def summary(reports: DataFrame) -> DataFrame:
    """facet, value, n, share: documents in all, with violations, by bucket; violations by technology and kind.

    Shares are of all documents; null if there are none.
    """
    rows = reports.select("n_violations", "trust_bucket", "violations")
    facets = F.array(
        F.struct(F.lit("documents").alias("facet"), F.lit("all").alias("value")),
        F.when(F.col("n_violations") > 0, F.struct(F.lit("documents").alias("facet"), F.lit("with violations").alias("value"))),
        F.struct(F.lit("bucket").alias("facet"), F.col("trust_bucket").alias("value")),
    )
    each = lambda field: F.transform("violations", lambda v: F.struct(F.lit(field).alias("facet"), v[field].alias("value")))
    counts = rows.select(F.explode(F.array_compact(F.concat(facets, each("tech"), each("kind")))).alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))
    total = reports.agg(F.count("*")).scalar()  # needs none of the audit's columns
    return counts.select("facet", "value", "n", (F.col("n") / total).alias("share"))
