"""Keys under which names are found in texts, so that many names need no pattern each.

A match of a name holds the name's characters, in whatever case.  Where the pattern
asks for something other than an ASCII letter or digit about the name, each run
of letters and digits in the name is a whole run of the text as well.  So a text
can only match a name if it has the name's keys: its runs; if it has none, its
pairs of neighbouring other characters; if it is a single such character, that.
Keys are compared folded, in one form for all characters that patterns take for
equal.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUN, PAIR, SINGLE = "run", "pair", "single"
_PATTERNS = {RUN: ("[a-z0-9]+", 0), PAIR: ("(?=([^a-z0-9]{2}))", 1), SINGLE: ("[^a-z0-9]", 0)}


@cache
def _equal() -> tuple[str, str]:
    """Characters that are another's equal through their capital, like the long s, and that other."""
    one = lambda c: len(c.upper()) == 1 == len(c.upper().lower()) and c.upper().lower() != c.lower()
    chars = [c for c in map(chr, range(0x20000)) if one(c)]  # no script above has cases
    return "".join(chars), "".join(c.upper().lower() for c in chars)


def fold(text: Column) -> Column:
    """text in one case; as many characters as before."""
    # Translation is slow, and ASCII texts, as long in bytes as in characters, need none.
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(F.lower(F.translate(text, "İ", "i")), *_equal()))


def folded(text: str) -> str:
    """``fold`` of a text at hand."""
    return text.replace("İ", "i").lower().translate(str.maketrans(*_equal()))


def _found(folded: Column, kind: str) -> Column:
    pattern, group = _PATTERNS[kind]
    return F.regexp_extract_all(folded, F.lit(pattern), group)


def text_keys(text: Column, kinds: Iterable[str] = (RUN,)) -> Column:
    """The distinct keys of these kinds that a text has."""
    folded = fold(F.coalesce(text, F.lit("")))
    return F.array_distinct(F.concat(F.array().cast("array<string>"), *(_found(folded, k) for k in kinds)))


#: Parts of the names that share a key.
PARTS = 64


def shuffled(rows: DataFrame) -> DataFrame:
    """rows, to be joined by a shuffle and not through the driver.

    Spark takes a table to be as small as its compressed file, whatever columns and
    rows are made of it, and would send out millions of names.
    """
    return rows.hint("merge")


def index(names: DataFrame, name: str = "name", open_start: Column | bool = False, open_end: Column | bool = False) -> DataFrame:
    """name, key, kind: one key for each distinct name, the one that fewest names share.

    open_start, open_end: at that end of the name letters and digits may go on, so
    that a run there need not be whole in a text.  Null and empty names go.  No
    names pass through the driver, however small their file is.
    """
    flag = lambda f: f if isinstance(f, Column) else F.lit(f)
    folded = F.col("folded")
    folded = F.when(flag(open_start), F.regexp_replace(folded, r"\A[a-z0-9]+", "")).otherwise(folded)
    folded = F.when(flag(open_end), F.regexp_replace(folded, r"[a-z0-9]+\z", "")).otherwise(folded)
    rows = names.where(F.col(name).isNotNull() & (F.col(name) != "")).withColumn("folded", fold(F.col(name))).select(F.col(name).alias("name"), folded.alias("folded")).distinct()
    kind = F.when(F.col("folded").rlike("[a-z0-9]"), RUN).when(F.col("folded").rlike("[^a-z0-9]{2}"), PAIR).otherwise(SINGLE)
    rows = rows.withColumn("kind", kind)
    keys = F.when(F.col("kind") == RUN, _found(F.col("folded"), RUN)).when(F.col("kind") == PAIR, _found(F.col("folded"), PAIR)).otherwise(_found(F.col("folded"), SINGLE))
    each = rows.select("name", "kind", F.explode(F.array_distinct(keys)).alias("key"))
    # A key that all names share is dealt out in parts by name, and counted as a whole from their counts.
    each = each.withColumn("part", F.pmod(F.xxhash64("name"), F.lit(PARTS)))
    shared = each.groupBy("key", "part").agg(F.count("*").alias("n")).withColumn("n", F.sum("n").over(Window.partitionBy("key")))
    best = F.min_by(F.struct("key", "kind"), F.struct("n", -F.length("key"), "key")).alias("best")
    return each.join(shuffled(shared), ["key", "part"]).groupBy("name").agg(best).select("name", "best.key", "best.kind")


def kinds_of(index: DataFrame) -> list[str]:
    """The kinds of key that an index has, three at most."""
    return sorted(r.kind for r in index.select("kind").distinct().collect())


#: Rows of an index that go out to all tasks; of a larger one go out bits of its keys, 2^BITS at most.
SENT, BITS = 50_000, 26


def meet(tokens: DataFrame, index: DataFrame) -> DataFrame:
    """tokens (column key, and others) beside the rows of an index that have their key.

    Most tokens have no name's key, and the commonest are in every text, so none is
    shuffled before its key is known to be in the index, or to share a bit with one.
    """
    if index.count() <= SENT:
        return tokens.join(F.broadcast(index), "key")
    place = F.xxhash64("key").bitwiseAND(F.lit((1 << BITS) - 1))
    word, at = F.shiftright(place, 6), place.bitwiseAND(F.lit(63)).cast("int")
    bits = index.select(word.alias("_word"), at.alias("_at")).groupBy("_word").agg(F.expr("bit_or(shiftleft(1L, _at))").alias("_bits"))
    near = tokens.withColumn("_word", word).join(F.broadcast(bits), "_word").where(F.getbit("_bits", at) == 1).drop("_word", "_bits")
    return near.join(shuffled(index), "key")
