"""Near-dedup of documents by SimHash, and by an exact check of five-word shingles.

Words are cut at ASCII white space, ASCII letters made small, as in operator 6.
Documents are near if, where asked for, operator 6 links their fingerprints
(three-word shingles, 3 bits of 64), or if the Jaccard likeness of their sets of
five-word shingles is at least ``LIKENESS``; a text of up to five words is one
shingle.  Of each component of near documents that of the least doc_id, then text
hash, stays.

1. Fingerprints, and the links among them by operator 6's search (``simhash``).
2. ``BANDS`` times ``ROWS`` minima a text; a pair at likeness 0.8 meets in no band
   with probability 0.000003, a pair at a higher one with less.
3. The texts that meet in a band are a bucket, whose pairs are verified on the sets
   themselves (``banding``).
4. Union-find over the links of both kinds, so that chains may alternate.

SimHash alone doesn't reach this likeness: at 0.8 some 10 of its 64 bits differ, and
segments long enough to be selective seldom differ by one bit.

Texts of equal words are one text under one name (128 bits of hash).  Nulls,
empty texts and texts of white space have no word and are copies of each other.
A very long text is one set of shingles, a word each.  Repeated rows count as
one; ties in doc_id and text hash are equal texts.  An empty table gives an empty
one.  Further columns pass through under whatever name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .banding import filtered, joined, links
from .common import checkpoint, column, named, of_rows, private, remove, slices, utf8, written
from .components import components
from .linededup import names

WORDS, LIKENESS = 5, 0.8
BANDS, ROWS = 24, 4
LIMIT = 1000
#: Hashes of words that a worker keeps.
KEPT = 400_000

_RANDOM = np.random.default_rng(20240301)
_FACTORS = _RANDOM.integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, np.uint32)
_PLACES = _RANDOM.integers(0, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_known: dict[bytes, int] = {}


def normal(text: bytes) -> bytes:
    return b" ".join(text.lower().split())


def shingles(text: bytes) -> np.ndarray:
    """The sorted distinct hashes of the word shingles of a normal text; none of an empty one."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_known) > KEPT:
        _known.clear()
    for w in words:
        if w not in _known:
            _known[w] = xxhash.xxh3_64_intdigest(w)
    h = np.array([_known[w] for w in words], np.uint64)
    if len(h) < WORDS:
        h = np.append(h, np.zeros(WORDS - len(h), np.uint64))
    x = np.zeros(len(h) - WORDS + 1, np.uint64)
    for i in range(WORDS):
        x = (x ^ h[i : i + len(x)]) * _PLACES[i]
        x ^= x >> np.uint64(29)
    return np.unique(x)


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """A key for each set (none empty) and band."""
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    x = np.concatenate(sets)
    x = ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(sets), np.uint64(b + 1))
        for i in range(b * ROWS, (b + 1) * ROWS):
            low = np.minimum.reduceat(x * _FACTORS[i] + _SHIFTS[i], starts)
            key = (key ^ low.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(32)
        out[:, b] = key
    return out


def _normals(batch: pa.RecordBatch) -> list[bytes]:
    data, offsets = utf8(column(batch, "text"))
    raw = data.tobytes()
    return [normal(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


_SEEN = "h1 long, h2 long, fp long, first struct<doc_id:bigint,th:bigint>, keys array<bigint>"


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text, with its fingerprint and the keys of those that have words; equal texts of a slice have these once."""
    for batch in slices(batches):
        block = _normals(batch)
        number: dict[bytes, int] = {}
        of = np.array([number.setdefault(t, len(number)) for t in block], np.int64)
        some, new = list(number), np.zeros(len(block), bool)
        new[np.unique(of, return_index=True)[1]] = True
        sets = [shingles(t) for t in some]
        full = np.array([len(x) > 0 for x in sets], bool)
        keys = np.zeros((len(some), BANDS), np.int64)
        if full.any():
            keys[full] = bands([x for x in sets if len(x)]).view(np.int64)
        counts = np.where(new & full[of], BANDS, 0)
        name = names(some)[of]
        prints = simhash.fingerprints(some).view(np.int64)[of]
        first = pa.StructArray.from_arrays([column(batch, "doc_id"), column(batch, "th")], ["doc_id", "th"])
        yield pa.RecordBatch.from_arrays(
            [pa.array(name[:, 0]), pa.array(name[:, 1]), pa.array(prints), first, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(keys[of[counts > 0]].ravel()))],
            ["h1", "h2", "fp", "first", "keys"],
        )


def _sought(held):
    """The sets of the texts whose names a filter may hold, once a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in slices(batches):
            block = [t for t in set(_normals(batch)) if t]
            name = names(block)
            some = filtered(name, bits)
            yield pa.RecordBatch.from_arrays([pa.array(name[some, 0]), pa.array(name[some, 1]), pa.array([shingles(block[i]).astype("<u8").tobytes() for i in some.tolist()], pa.binary())], ["h1", "h2", "item"])

    return run


def near(items: list[bytes]) -> tuple[list[int], list[int], np.ndarray]:
    """Links (indices) from the members of each component by exact likeness to its first set, and each set's first."""
    sizes = [len(x) // 8 for x in items]
    return joined(np.repeat(np.arange(len(items)), sizes), np.frombuffer(b"".join(items), "<u8"), len(items), LIKENESS)


def _alike(prints: DataFrame) -> DataFrame:
    """a, b: links from the names (h1, h2, distinct) of each component of fingerprints (fp) to its least name."""
    linked = components(simhash.links(checkpoint(prints.select("fp").distinct()))).select(F.col("node").alias("fp"), F.col("component").alias("class"))
    of = checkpoint(prints.join(linked, "fp", "left").select(F.struct("h1", "h2").alias("a"), F.coalesce("class", "fp").alias("class")))
    least = checkpoint(of.groupBy("class").agg(F.min("a").alias("b"), F.count("*").alias("n")).where("n > 1"))
    return of.join(least, "class").where("a <> b").select("a", "b")


def representatives(docs: DataFrame, limit: int = LIMIT, by_prints: bool = False) -> DataFrame:
    """One row of docs, all columns, for each component: that of the least doc_id, then text hash.

    Nulls come first among ids; equal rows count as one.  by_prints: operator 6's links join texts too.
    """
    rows = of_rows(docs, "doc_id", "text").withColumn("th", F.xxhash64("text"))
    seen, path = written(rows.mapInArrow(_seen, _SEEN), "texts")
    found = links(seen.select("h1", "keys"), lambda held: rows.select("text").mapInArrow(_sought(held), "h1 long, h2 long, item binary"), near, limit)
    texts = checkpoint(seen.groupBy("h1", "h2").agg(F.min("first").alias("k"), F.min("fp").alias("fp")))
    remove(docs.sparkSession, path)
    of = components(found.unionByName(_alike(texts)) if by_prints else found).select("node.h1", "node.h2", "component")
    each = checkpoint(texts.select("h1", "h2", "k").join(of, ["h1", "h2"], "left"))
    alone = each.where("component is null").select("k")
    joined_texts = each.where("component is not null").groupBy("component").agg(F.min("k").alias("k")).select("k")
    doc, text, th = private(docs, "kept_doc", "kept_th", "th")
    kept = checkpoint(alone.unionByName(joined_texts).select(F.col("k.doc_id").alias(doc), F.col("k.th").alias(text)))
    keyed = docs.withColumn(th, F.xxhash64(named("text")))
    same = named("doc_id").eqNullSafe(named(doc)) & named(th).eqNullSafe(named(text))
    return keyed.join(kept, same, "left_semi").dropDuplicates(["doc_id", th]).select(*map(named, docs.columns))
