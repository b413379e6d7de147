"""Operator 6: SimHash near-dedup by deletion-variant signatures.

A fingerprint has 64 bits; bit i is set if it is set in over half of the XXH64
hashes (seed 42) of the text's word shingles.  Fingerprints link at ``bits`` or
fewer differing bits.  Cut into bits // 2 + 1 segments, two that link have one
segment that differs by one bit at most; so each segment is indexed once for
each of its bits with that bit wildcarded, an equality join on these variants
finds all links, and bit_count verifies them.

Work is done on distinct fingerprints, so exact copies cost nothing further.
Variants are shuffled once; buckets of up to ``LIMIT`` are searched for components
in one task.  A larger bucket streams through it: its fingerprints, of which each
would be compared with thousands, are joined by equality too: a fingerprint within bits // 2 of a point links to all within the rest of
it, so each is dealt to the points about it (at three bits 65 and 2,081), however
many there are, and meets the least fingerprint of each.  This loses no link and
adds none, like the comparison that it stands for.

Null and empty texts, and texts of white space, have fingerprint zero, linked
as any other.  A very long text is one fingerprint, by counts over all its
shingles.  Rows with equal doc_id are each kept; a null doc_id is never a
component's id unless all its ids are null.  Ties in bits (exactly half) are 0.
Empty tables give empty ones.  Further columns pass through ``signatures`` and
``representatives`` under whatever name, but that ``signatures`` replaces text and
``fingerprint``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, column, mapped, named, of_rows, private, slices, utf8
from .components import components

WORDS, BITS = 3, 3
#: Members of a bucket that one task compares; larger buckets go through points.
LIMIT = 4096

#: Each bit of a byte in a byte of its own.
_LANES = np.array([sum((b >> i & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)


def fingerprints(texts: list[bytes], words: int = WORDS) -> np.ndarray:
    """Unsigned 64-bit fingerprints of UTF-8 texts."""
    digest, hashes, sizes = xxhash.xxh64_intdigest, [], []
    for text in texts:
        found = text.lower().split()
        n = len(found)
        if n <= words:
            sizes.append(min(n, 1))
            if n:
                hashes.append(digest(b" ".join(found), 42))
            continue
        joined = b" ".join(found)
        ends = np.append(np.flatnonzero(np.frombuffer(joined, np.uint8) == 32), len(joined))
        begins = np.append(0, ends[:-1] + 1)
        sizes.append(n - words + 1)
        hashes += [digest(joined[a:b], 42) for a, b in zip(begins[: n - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]
    sizes = np.array(sizes, np.int64)
    out = np.zeros(len(texts), np.uint64)
    if not hashes:
        return out
    h = np.array(hashes, np.uint64)
    # Runs of up to 255 hashes of one text, so that eight counts fit the lanes of a word.
    runs = -(-sizes // 255)
    of = np.repeat(np.arange(len(texts)), runs)
    within = np.arange(len(of)) - np.repeat(np.cumsum(runs) - runs, runs)
    starts = (np.cumsum(sizes) - sizes)[of] + 255 * within
    some = np.flatnonzero(sizes)
    firsts = (np.cumsum(runs) - runs)[some]
    view = h.astype("<u8").view(np.uint8).reshape(-1, 8)
    for byte in range(8):
        lanes = np.add.reduceat(_LANES[view[:, byte]], starts)
        counts = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), firsts, axis=0)
        over = 2 * counts > sizes[some, None]
        out[some] |= (over.astype(np.uint64) << np.arange(8, dtype=np.uint64)).sum(axis=1).astype(np.uint64) << np.uint64(8 * byte)
    return out


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """All columns of docs but text, and fingerprint (long, the unsigned value's bits)."""
    docs = docs.select(*[named(c) for c in docs.columns if c.lower() != "fingerprint"])
    place, kept = docs.columns.index("text"), [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = utf8(batch.column(place))
            raw = data.tobytes()
            prints = fingerprints([raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], words)
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != place), pa.array(prints.view(np.int64))], [*kept, "fingerprint"])

    return mapped(docs, run, docs.select(*map(named, kept)).schema.add("fingerprint", "long"))


def variants(bits: int) -> list:
    """Columns: for each segment and each of its bits, the key with that bit wildcarded."""
    count = bits // 2 + 1
    cuts = [64 * i // count for i in range(count + 1)]
    keys = []
    for s in range(count):
        for p in range(cuts[s], cuts[s + 1]):
            mask = ((1 << cuts[s + 1]) - (1 << cuts[s])) & ~(1 << p)
            signed = mask - (1 << 64) if mask >> 63 else mask
            keys.append(F.xxhash64(F.lit(p), F.col("fp").bitwiseAND(F.lit(signed).cast("long"))))
    return keys


def _forest(fps: np.ndarray, bits: int) -> tuple[list[int], list[int]]:
    """Edges from the members of each component to its first member."""
    rest, a, b = np.unique(fps).view(np.uint64), [], []  # bit counts are of magnitudes, so unsigned
    while len(rest):
        root, todo, rest = rest[0], [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            near = np.bitwise_count(rest ^ x) <= bits
            if near.any():
                new = rest[near]
                rest = rest[~near]
                a += new.view(np.int64).tolist()
                b += [int(root.view(np.int64))] * len(new)
                todo += list(new)
    return a, b


def _runs(bits: int, limit: int):
    """Edges (a, b) within buckets, from rows sorted by key; of a bucket above ``limit`` its members as a, b null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        key_held, size = None, 0

        def out(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b, pa.int64())], ["a", "b"])

        def settle() -> Iterator[pa.RecordBatch]:
            if size > limit:
                yield out(np.concatenate(held), None)
            elif size > 1:
                yield out(*_forest(np.concatenate(held), bits))

        for batch in batches:
            key, fp = (column(batch, c).to_numpy() for c in ("key", "fp"))
            if not len(key):
                continue
            starts = np.append(0, np.flatnonzero(key[1:] != key[:-1]) + 1)
            sizes = np.diff(np.append(starts, len(key)))
            if key[0] == key_held:
                held.append(fp[: sizes[0]])
                size += int(sizes[0])
                if size > limit:  # no more of it need be kept
                    yield from settle()
                    held = [fp[:0]]
                starts, sizes = starts[1:], sizes[1:]
            if not len(starts):
                continue
            yield from settle()
            # Within the batch: pairs at once, the others one by one; the last may go on.
            pair = starts[:-1][sizes[:-1] == 2]
            pair = pair[np.bitwise_count((fp[pair] ^ fp[pair + 1]).view(np.uint64)) <= bits]
            yield out(fp[pair + 1], fp[pair])
            for i in np.flatnonzero(sizes[:-1] > 2).tolist():
                held, size = [fp[starts[i] : starts[i] + sizes[i]]], int(sizes[i])
                yield from settle()
            key_held, held, size = key[-1], [fp[starts[-1] :].copy()], int(sizes[-1])
        yield from settle()

    return run


def links(prints: DataFrame, bits: int = BITS, limit: int = LIMIT) -> DataFrame:
    """Edges (a, b) that join the fingerprints (column fp, distinct) of each component."""
    # Dealt out by number first, since each row becomes many.
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = prints.repartition(parts, "fp").select("fp", F.explode(F.array(*variants(bits))).alias("key"))
    met = checkpoint(keys.repartition("key").sortWithinPartitions("key").mapInArrow(_runs(bits, limit), "a long, b long"))
    found, hot = met.where("b is not null"), met.where("b is null")
    if not hot.isEmpty():
        found = found.unionByName(_through_points(checkpoint(hot.select(F.col("a").alias("fp")).distinct()), bits))
    return found.distinct()


def _through_points(hot: DataFrame, bits: int) -> DataFrame:
    """Links fingerprints by points within bits // 2 of one and the rest of the other."""
    def ball(radius: int) -> DataFrame:
        out = hot.select("fp", F.col("fp").alias("z"), F.lit(-1).alias("last"))
        level = out
        for _ in range(radius):
            level = level.select("fp", "z", F.explode(F.expr("filter(sequence(0, 63), i -> i > last)")).alias("last")).select("fp", F.expr("z ^ shiftleft(1L, last)").alias("z"), "last")
            out = out.unionByName(level)
        return out.select("fp", "z")

    near = bits // 2
    centres = checkpoint(ball(near).groupBy("z").agg(F.min("fp").alias("b")))
    return ball(bits - near).join(centres, "z").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def grouped(docs: DataFrame, words: int = WORDS, bits: int = BITS, limit: int = LIMIT) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hexadecimal digits), component_id for each row of docs."""
    prints = checkpoint(signatures(of_rows(docs, "doc_id", "text"), words))
    return _classes(prints, bits, limit).select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def _classes(prints: DataFrame, bits: int, limit: int, name: str = "component_id") -> DataFrame:
    """prints with component_id, or with class, the least fingerprint of the component."""
    each = checkpoint(prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("least")))
    linked = components(links(each.select("fp"), bits, limit))
    member = linked.join(each, linked.node == each.fp).select("fp", "component", "least")
    if name == "class":
        each = each.join(member.select(F.col("fp").alias("node"), "component"), each.fp == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias(name))
    else:
        member = checkpoint(member)
        ids = checkpoint(member.groupBy("component").agg(F.min("least").alias(name)))
        of = member.join(ids, "component").select(F.col("fp").alias("node"), name)
        each = each.join(of, each.fp == of.node, "left").select("fp", F.coalesce(name, "least").alias(name))
    # Written, so that the join of a fingerprint with very many rows can be split.
    each = checkpoint(each)
    return prints.join(each, prints.fingerprint == each.fp).drop("fp")


def representatives(docs: DataFrame, words: int = WORDS, bits: int = BITS, limit: int = LIMIT) -> DataFrame:
    """One row of docs, all columns, for each component: that of the least doc_id, then text hash.

    Nulls come first among ids; equal rows count as one.
    """
    rows = of_rows(docs, "doc_id", "text").withColumn("th", F.xxhash64("text"))
    prints = checkpoint(signatures(rows, words))
    doc, text, th = private(docs, "kept_doc", "kept_th", "th")
    kept = _classes(prints, bits, limit, "class").groupBy("class").agg(F.min(F.struct("doc_id", "th")).alias("k")).select(F.col("k.doc_id").alias(doc), F.col("k.th").alias(text))
    keyed = docs.withColumn(th, F.xxhash64(named("text")))
    same = named("doc_id").eqNullSafe(named(doc)) & named(th).eqNullSafe(named(text))
    return keyed.join(kept, same, "left_semi").dropDuplicates(["doc_id", th]).select(*map(named, docs.columns))
