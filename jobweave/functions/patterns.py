r"""Regular expressions for Spark's (Java's) engine.

``(?U)`` makes \d, \s and \b, and ``(?iu)`` the ignoring of case, follow
Unicode; Java's defaults are ASCII only.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocabulary import HANGUL, PARTICLES

#: Matches nothing: no character comes before the text's beginning.
NEVER = r"[\s\S]\A"
#: What Unicode strips from both ends: white space and the separators U+001C to U+001F.
OUTER_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"
LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
BULLETS = "^[ \\-\\u2022\\u00b7*\\t]+|[ \\-\\u2022\\u00b7*\\t]+\\z"
# How years of experience, calendar years, versions, sentences and a model's answer are written.
EXPERIENCE = r"(?U)(\d+)\s*년\s*(?:이상|이하|차)?"
YEAR = r"(?U)(?<!\d)(19[8-9]\d|20[0-2]\d)(?=년|[\s.\-/,)\]]|$)"
VERSION = r"(?U)\bv?(\d+(?:\.\d+){0,2})\b"
AUDIT_SENTENCE = "(?U)(?<=[.!?。])\\s+|\\n+"
DETECTOR_SENTENCE = "[.!?。\\n]+"
IMPLIED_ANSWER = r"(?sU)IMPLICIT:\s*(\[.*?\])"


def quoted(text: str) -> str:
    """text as a pattern for itself."""
    return "".join(c if c.isalnum() or ord(c) > 127 else f"\\{c}" if c.isprintable() and c != " " else f"\\x{ord(c):02x}" for c in text)


def keywords(words: Iterable[str]) -> str:
    """Any of the words, the longest first, without an ASCII letter or digit about it; group 1."""
    known = sorted({w.lower() for w in words if w}, key=lambda w: (-len(w), w))
    if not known:
        return f"({NEVER})"
    return f"(?iu)(?<![a-zA-Z0-9])({'|'.join(map(quoted, known))})(?![a-zA-Z0-9])"


def category(word: str) -> str:
    """An ASCII word as a word of its own."""
    return f"(?iu)(?<![a-z0-9]){quoted(word.lower())}(?![a-z0-9])"


def name(word: str) -> str:
    """A name in running text, without flags.

    ASCII names stand between non-alphanumeric characters.  Others may be
    followed by one or two particles, but not by further Korean letters.
    """
    if word.isascii():
        return f"(?<![a-zA-Z0-9]){quoted(word)}(?![a-zA-Z0-9])"
    return f"(?<![{HANGUL}a-zA-Z0-9]){quoted(word)}(?:[{PARTICLES}]{{1,2}}(?![{HANGUL}])|(?![{HANGUL}]))"


#: A text of ASCII characters alone.
ASCII = r"\A[\x00-\x7f]*\z"


def quoted_of(text: Column) -> Column:
    """``quoted`` for the texts of a column."""
    return F.concat(F.lit("\\Q"), F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def name_of(word: Column) -> Column:
    """``name`` for the names of a column, with flags."""
    plain = F.concat(F.lit("(?iu)(?<![a-zA-Z0-9])"), quoted_of(word), F.lit("(?![a-zA-Z0-9])"))
    korean = F.concat(F.lit(f"(?iu)(?<![{HANGUL}a-zA-Z0-9])"), quoted_of(word), F.lit(f"(?:[{PARTICLES}]{{1,2}}(?![{HANGUL}])|(?![{HANGUL}]))"))
    return F.when(word.rlike(ASCII), plain).otherwise(korean)


def any_name(words: Iterable[str]) -> str:
    """Any of an entry's names; no name never matches."""
    known = [w for w in words if w]
    return f"(?iu)(?:{'|'.join(map(name, known))})" if known else NEVER
