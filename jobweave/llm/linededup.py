"""Operator 2: fuzzy line dedup by MinHash.

Lines (cut at line feeds) are compared in small letters without outer white
space; blank lines are no lines and stay.  Lines are near if the Jaccard
likeness of their sets of eight-byte shingles (UTF-8) is at least 0.8; a line of
up to eight bytes is one shingle.  Of each component of near lines the first
occurrence stays (by doc_id, text hash and line number), all others go.

1. Signatures of ``BANDS`` times ``ROWS`` minima; a pair at likeness 0.8 meets in
   a band with probability 0.985, at 0.9 with more than 0.999.  In each slice of
   text equal lines are one row with all their places, so a line that is
   everywhere has one row a slice.
2. The lines that meet in a band are a bucket, whose pairs are verified by exact
   Jaccard likeness (``banding``).
3. Distributed union-find over the verified links, exact repeats by hash.

Nulls and empty texts have no line and stay.  Rows of one doc_id and equal text
count as one; null doc_ids come first.  A very long text is a slice of its own;
a very long line is one set of shingles, a word each byte.  Ties can't be: places
differ.  An empty table gives an empty one.  Signatures find near lines with the
probabilities above; equal lines always.  Further columns pass through under
whatever name, but for ``n_lines`` and ``n_dropped`` in ``deduplicated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .banding import LIMIT, filtered, joined, links
from .common import checkpoint, column, mapped, named, of_rows, private, remove, slices, texts, written
from .components import components

SHINGLE, LIKENESS = 8, 0.8
BANDS, ROWS = 8, 4
#: Shingles that are hashed at once, so that they stay in the processor's cache.
CHUNK = 1 << 15

_RANDOM = np.random.default_rng(20240229)
_FACTORS = _RANDOM.integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, np.uint32)


def normal(line: str) -> bytes:
    return line.strip().lower().encode()


def shingles(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The eight-byte windows of all lines, and where each line's begin."""
    data = b"".join(x if len(x) >= SHINGLE else x.ljust(SHINGLE, b"\0") for x in lines)
    sizes = np.array([max(len(x), SHINGLE) for x in lines], np.int64)
    ends = np.cumsum(sizes)
    windows = np.ndarray((len(data) - SHINGLE + 1,), "<u8", data, strides=(1,))
    keep = np.ones(len(windows), bool)
    for i in range(1, SHINGLE):
        keep[ends[:-1] - i] = False  # windows across two lines
    counts = sizes - SHINGLE + 1
    return windows[keep], np.cumsum(counts) - counts


def _minima(lines: list[bytes]) -> np.ndarray:
    windows, starts = shingles(lines)
    x = windows * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x = (x >> np.uint64(32)).astype(np.uint32)
    out, room = np.empty((BANDS * ROWS, len(lines)), np.uint32), np.empty_like(x)
    for i in range(BANDS * ROWS):
        np.multiply(x, _FACTORS[i], out=room)
        room += _SHIFTS[i]
        np.minimum.reduceat(room, starts, out=out[i])
    return out


def bands(lines: list[bytes]) -> np.ndarray:
    """A key for each line and band."""
    parts, at, size = [], 0, 0
    for i, line in enumerate(lines):
        size += len(line)
        if size >= CHUNK:
            parts.append(_minima(lines[at : i + 1]))
            at, size = i + 1, 0
    if at < len(lines):
        parts.append(_minima(lines[at:]))
    low = np.concatenate(parts, axis=1)
    out = np.empty((len(lines), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(lines), np.uint64(b + 1))
        for i in range(b * ROWS, (b + 1) * ROWS):
            key = (key ^ low[i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(32)
        out[:, b] = key
    return out


def names(lines: list[bytes]) -> np.ndarray:
    """128 bits of hash for each line, in two columns."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(x) for x in lines]), ">i8").astype(np.int64).reshape(-1, 2)


_SEEN = "h1 long, h2 long, places array<struct<doc_id:bigint,th:bigint,line_no:int>>, keys array<bigint>"


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each distinct line of a slice: its name, where it is, its keys."""
    for batch in slices(batches):
        number: dict[bytes, int] = {}
        of, rows, numbers = [], [], []
        for row, text in enumerate(texts(column(batch, "text"))):
            for line_no, line in enumerate(text.split("\n")):
                if x := normal(line):
                    of.append(number.setdefault(x, len(number)))
                    rows.append(row)
                    numbers.append(line_no)
        if not number:
            continue
        lines, of = list(number), np.array(of, np.int64)
        order = np.argsort(of, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(lines)))]).astype(np.int32)
        rows = pa.array(np.array(rows, np.int64)[order])
        places = pa.StructArray.from_arrays([column(batch, "doc_id").take(rows), column(batch, "th").take(rows), pa.array(np.array(numbers, np.int32)[order])], ["doc_id", "th", "line_no"])
        name, keys = names(lines), bands(lines).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(name[:, 0]), pa.array(name[:, 1]), pa.ListArray.from_arrays(pa.array(ends), places), pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))],
            ["h1", "h2", "places", "keys"],
        )


def near(lines: list[bytes]) -> tuple[list[int], list[int], np.ndarray]:
    """Links (indices) from the members of each component by exact Jaccard likeness to its first line, and each line's first."""
    windows, starts = shingles(lines)
    return joined(np.repeat(np.arange(len(lines)), np.diff(np.append(starts, len(windows)))), windows, len(lines), LIKENESS)


def _sought(held):
    """Texts of the lines whose names a filter may hold, once a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in slices(batches):
            lines = list({x for t in texts(column(batch, "text")) for line in t.split("\n") if (x := normal(line))})
            name = names(lines)
            some = filtered(name, bits)
            yield pa.RecordBatch.from_arrays([pa.array(name[some, 0]), pa.array(name[some, 1]), pa.array([lines[i] for i in some.tolist()], pa.binary())], ["h1", "h2", "item"])

    return run


def dropped(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, th (the text's xxhash64), lines: the numbers of the lines that go, for documents that have any."""
    docs = of_rows(docs, "doc_id", "text").where("text is not null")
    seen, path = written(docs.withColumn("th", F.xxhash64("text")).mapInArrow(_seen, _SEEN), "lines")
    found = links(seen.select("h1", "keys"), lambda held: docs.select("text").mapInArrow(_sought(held), "h1 long, h2 long, item binary"), near, limit)
    near_lines = components(found).select("node.h1", "node.h2", "component")
    each = seen.select("h1", "h2", F.size("places").alias("n"), F.array_min("places").alias("first")).groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    each = checkpoint(each.join(near_lines, ["h1", "h2"], "left").where("n > 1 or component is not null"))
    # Written apart, so that the join of a large component's lines can be split.
    stays = checkpoint(each.where("component is not null").groupBy("component").agg(F.min("first").alias("stays")))
    each = checkpoint(each.join(stays, "component", "left").select("h1", "h2", F.coalesce("stays", "first").alias("stays")))
    gone = seen.select("h1", "h2", "places").join(each, ["h1", "h2"]).select("stays", F.explode("places").alias("p")).where(~F.col("p").eqNullSafe(F.col("stays")))
    gone = checkpoint(gone.groupBy("p.doc_id", "p.th").agg(F.collect_set("p.line_no").alias("lines")))
    remove(docs.sparkSession, path)
    return gone


def _reduced(docs: DataFrame, limit: int) -> tuple[DataFrame, str, str]:
    """docs, text without its dropped lines, and two columns: how many lines (not blank) there were, how many went."""
    th, doc, key, lines, n_lines, n_dropped = private(docs, "th", "gone_doc", "gone_th", "gone_lines", "n_lines", "n_dropped")
    gone = dropped(docs, limit).toDF(doc, key, lines)
    rows = docs.withColumn(th, F.xxhash64(named("text")))
    rows = rows.join(gone, named("doc_id").eqNullSafe(named(doc)) & (named(th) == named(key)), "left").select(*map(named, docs.columns), named(lines))
    columns = docs.columns
    place = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kept, counts, drops = [], [], []
            for text, gone in zip(batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                parts, gone = (text or "").split("\n"), set(gone or ())
                counts.append(sum(1 for x in parts if x.strip()))
                drops.append(len(gone))
                kept.append("\n".join(x for i, x in enumerate(parts) if i not in gone) if gone else text)
            arrays = batch.columns[:-1]
            arrays[place] = pa.array(kept, pa.string())
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(counts, pa.int64()), pa.array(drops, pa.int64())], [*columns, n_lines, n_dropped])

    schema = docs.select(*map(named, columns)).schema.add(n_lines, "long").add(n_dropped, "long")
    return mapped(rows, run, schema), n_lines, n_dropped


def deduplicated(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """All columns of docs, text without its dropped lines, and n_lines, n_dropped (of lines that aren't blank).

    Columns of docs under the two latter names are replaced.
    """
    docs = docs.select(*[named(c) for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")])
    return _reduced(docs, limit)[0]


def remaining(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The columns of docs, text without its dropped lines, n_chars (if any) anew; a document that lost all its lines goes."""
    rows, n_lines, n_dropped = _reduced(docs, limit)
    lines, gone = named(n_lines), named(n_dropped)
    rows = rows.where((gone == 0) | (gone < lines))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(gone > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*map(named, docs.columns))
