"""Text operators as Column expressions; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns
from .vocabulary import IMPLIED_PROMPT, JOB_CATEGORIES, NO_SKILLS, OTHER, SKILL_ALIASES, TECH_KEYWORDS, UNCATEGORIZED

_DIGITS = "".join(chr(start + i) for start in (0xFF10, 0x0660, 0x06F0, 0x0966) for i in range(10))


def strip(text: Column) -> Column:
    """Without outer Unicode white space."""
    return F.regexp_replace(text, patterns.OUTER_SPACE, "")


def or_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def filled(values: Column) -> Column:
    """The elements that aren't empty; null elements go."""
    return F.filter(values, lambda v: v.isNotNull() & (v != ""))


def matches(text: Column, pattern: str) -> Column:
    """Group 1 of all matches."""
    return F.regexp_extract_all(or_empty(text), F.lit(pattern), 1)


def integers(values: Column) -> Column:
    """Digit strings as ints, any Unicode digits; what doesn't fit an int goes."""
    return F.filter(F.transform(values, lambda v: F.translate(v, _DIGITS, "0123456789" * 4).try_cast("int")), lambda v: v.isNotNull())


def find_keywords(text: Column, words: Iterable[str] = TECH_KEYWORDS) -> Column:
    """Distinct keywords in small letters, sorted.  A null text has none."""
    return F.array_sort(F.array_distinct(F.transform(matches(text, patterns.keywords(words)), F.lower)))


def experience_years(text: Column) -> Column:
    """All numbers of years, in order, repeats included."""
    return integers(matches(text, patterns.EXPERIENCE))


def claim_years(sentence: Column) -> Column:
    """Calendar years from 1980 to 2029 that read as years."""
    return integers(matches(sentence, patterns.YEAR))


def version_tokens(sentence: Column) -> Column:
    return matches(sentence, patterns.VERSION)


def audit_sentences(text: Column) -> Column:
    """Sentences that end with a mark and white space, or a line; stripped, none blank."""
    return F.filter(F.transform(F.split(or_empty(text), patterns.AUDIT_SENTENCE), strip), lambda s: s != "")


def detector_sentences(text: Column) -> Column:
    """Stretches between sentence marks of more than five characters."""
    return F.filter(F.transform(F.split(or_empty(text), patterns.DETECTOR_SENTENCE), strip), lambda s: F.length(s) > 5)


def clean_lines(text: Column) -> Column:
    """Lines without outer spaces, tabs and bullets; none blank."""
    return F.filter(F.transform(F.split(or_empty(text), patterns.LINE_BREAK), lambda s: F.regexp_replace(s, patterns.BULLETS, "")), lambda s: s != "")


def normalize_skill(raw: Column, aliases: Mapping[str, str] = SKILL_ALIASES) -> Column:
    """Small letters, stripped, the standard form if it is an alias; null and blank give the empty string."""
    token = strip(F.lower(or_empty(raw)))
    if not aliases:
        return token
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.try_element_at(table, token), token)


def normalize_category(raw: Column, rules: Sequence[tuple[str, Sequence[str]]] = JOB_CATEGORIES, empty: str = UNCATEGORIZED, other: str = OTHER) -> Column:
    """The first category with a matching pattern.

    ASCII patterns match as words of their own, others anywhere.
    """
    low = F.lower(raw)
    found = F.when(raw.isNull() | (raw == ""), empty)
    for category, words in rules:
        ascii_words = [w.lower() for w in words if w.isascii()]
        tests = [low.contains(w.lower()) for w in words if not w.isascii()]
        if ascii_words:
            tests.append(raw.rlike("(?iu)(?<![a-z0-9])(?:" + "|".join(map(patterns.quoted, ascii_words)) + ")(?![a-z0-9])"))
        if tests:
            any_of = tests[0]
            for t in tests[1:]:
                any_of = any_of | t
            found = found.when(any_of, category)
    return found.otherwise(other)


def union_sorted(*arrays: Column) -> Column:
    """Distinct elements of all arrays, sorted; null arrays are empty."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.flatten(F.array(*[F.coalesce(a, none) for a in arrays]))))


def posting_skills(text: Column, tags: Column, words: Iterable[str] = TECH_KEYWORDS, aliases: Mapping[str, str] = SKILL_ALIASES, align: bool = False) -> Column:
    """Keywords in the text and normalised tags, sorted.

    Keywords from the text stay as written unless ``align`` asks for their
    standard forms as well.
    """
    return skills_united(find_keywords(text, words), tags, aliases, align)


def skills_united(found: Column, tags: Column, aliases: Mapping[str, str] = SKILL_ALIASES, align: bool = False) -> Column:
    """Keywords found in a text and normalised tags, sorted."""
    if align:
        found = F.transform(found, lambda s: normalize_skill(s, aliases))
    return union_sorted(found, filled(F.transform(tags, lambda s: normalize_skill(s, aliases))))


def implied_prompt(text: Column, skills: Column) -> Column:
    """The prompt that asks a language model for implied skills."""
    listed = F.coalesce(F.nullif(F.array_join(skills, ", "), F.lit("")), F.lit(NO_SKILLS))
    before, rest = IMPLIED_PROMPT.split("{job_text}")
    between, after = rest.split("{explicit_skills}")
    return F.concat(F.lit(before), strip(or_empty(text)), F.lit(between), listed, F.lit(after))


def parse_implied(answer: Column) -> Column:
    """The strings of the first ``IMPLICIT: [...]``; nothing if there is none or it isn't JSON.

    Elements that aren't strings come as JSON text; nulls go.
    """
    found = F.regexp_extract(or_empty(answer), patterns.IMPLIED_ANSWER, 1)
    parsed = F.coalesce(F.from_json(found, "array<string>"), F.array().cast("array<string>"))
    return filled(F.transform(parsed, strip))


def ai_probability(perplexity: Column, burstiness: Column) -> Column:
    """0 to 1, three decimals: low perplexity and even sentences look generated."""
    bounded = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return F.bround(0.6 * bounded((60.0 - perplexity) / 60.0) + 0.4 * bounded((15.0 - burstiness) / 15.0), 3)


def trust_score(violations: Column, probability: Column | None = None) -> Column:
    """100, less 15 for each violation up to 60, less up to 30 for generated text."""
    score = F.lit(100) - F.least(F.lit(60), 15 * violations)
    if probability is not None:
        score = score - F.bround(30 * F.coalesce(probability, F.lit(0.0)), 0).cast("int")
    return F.greatest(F.lit(0), score).cast("int")


def trust_bucket(score: Column) -> Column:
    return F.when(score >= 100, "100").when(score >= 85, "85-99").when(score >= 70, "70-84").otherwise("<70")


def preview(text: Column, length: int = 120) -> Column:
    return F.translate(F.substring(text, 1, length), "\n", " ")
