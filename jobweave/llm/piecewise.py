"""Operator 4: document fingerprints by context-triggered piecewise hashing.

A rolling hash over seven bytes ends a piece wherever it is the block size's
last residue; each piece gives one of 64 characters.  The block size is 3 times
the power of two that leaves about ``PIECES`` pieces.  A fingerprint is
``block:signature:signature at twice the block``.  Texts are compared at block
sizes that are equal or differ by a factor of two: likeness is one less the
edit distance of the signatures over the longer one's length, and zero without
a common run of ``RUN`` characters (of the shorter one's length, if below).

Signatures of one text have at most 64 characters: what comes after the 63rd
piece is one last piece, so every byte counts.  Runs of more than three equal
characters count as three in comparisons.  Null and empty texts have the
fingerprint ``3::``; equal fingerprints have likeness one.  A very long text has
64 pieces like any other.  Repeated rows are each judged, and follow one another;
documents of equal doc_id come by text, null doc_ids first.  The last
document's next is the first, which may be itself.  An empty table gives an empty
one; further columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, of_rows, slices, texts, written

ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
SMALLEST, PIECES, LONGEST, WINDOW, RUN = 3, 64, 64, 7, 4


def rolling(data: np.ndarray) -> np.ndarray:
    """Hash of the last seven bytes at each position; fewer at the start."""
    padded = np.concatenate([np.zeros(WINDOW - 1, np.uint32), data.astype(np.uint32)])
    out = np.zeros(len(data), np.uint32)
    for i in range(WINDOW):
        out += padded[i : i + len(data)] * np.uint32(pow(0x01000193, WINDOW - i, 1 << 32))
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    out ^= out >> np.uint32(13)
    return out


def _signature(raw: bytes, ends: np.ndarray) -> bytes:
    if not raw:
        return b""
    cuts = [0, *(ends[: LONGEST - 1] + 1).tolist()]
    if cuts[-1] < len(raw):
        cuts.append(len(raw))
    digest = xxhash.xxh32_intdigest
    return bytes(ALPHABET[digest(raw[a:b]) & 63] for a, b in zip(cuts, cuts[1:], strict=False))


def fingerprint(raw: bytes) -> str:
    """``block:signature:signature at twice the block`` of a text's bytes."""
    block = SMALLEST
    while block * PIECES < len(raw):
        block *= 2
    h = rolling(np.frombuffer(raw, np.uint8))
    while True:
        ends = np.flatnonzero(h % np.uint32(block) == block - 1)
        if len(ends) >= PIECES // 2 or block == SMALLEST:
            break
        block //= 2
    twice = ends[h[ends] % np.uint32(2 * block) == 2 * block - 1]
    return f"{block}:{_signature(raw, ends).decode()}:{_signature(raw, twice).decode()}"


def _squeezed(s: str) -> str:
    """At most three equal characters in a row."""
    return "".join(c for i, c in enumerate(s) if i < 3 or not s[i - 3] == s[i - 2] == s[i - 1] == c)


def distances(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Edit distances of pairs of strings of up to 64 bytes, by Myers' recurrence on all pairs at once."""
    n, one = len(a), np.uint64(1)
    la, lb = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    peq = np.zeros((n, 128), np.uint64)
    flat = np.frombuffer(b"".join(a), np.uint8)
    row = np.repeat(np.arange(n), la)
    bit = one << (np.arange(len(flat)) - np.repeat(np.cumsum(la) - la, la)).astype(np.uint64)
    np.bitwise_or.at(peq, (row, flat), bit)
    text = np.zeros((n, max(1, int(lb.max(initial=0)))), np.uint8)
    text[np.repeat(np.arange(n), lb), np.arange(int(lb.sum())) - np.repeat(np.cumsum(lb) - lb, lb)] = np.frombuffer(b"".join(b), np.uint8)
    pv, mv, score = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros(n, np.uint64), la.copy()
    last = one << np.maximum(la - 1, 0).astype(np.uint64)
    for j in range(int(lb.max(initial=0))):
        eq = peq[np.arange(n), text[:, j]]
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        step = ((ph & last) != 0).astype(np.int64) - ((mh & last) != 0)
        score = np.where(j < lb, score + step, score)
        ph, mh = (ph << one) | one, mh << one
        pv, mv = mh | ~(xv | ph), ph & xv
    return np.where(la == 0, lb, score)


def _common_run(a: str, b: str) -> bool:
    n = min(RUN, len(a), len(b))
    if not n:
        return False
    held = {a[i : i + n] for i in range(len(a) - n + 1)}
    return any(b[i : i + n] in held for i in range(len(b) - n + 1))


def likeness(pairs: list[tuple[str, str]]) -> np.ndarray:
    """0 to 1 for each pair of fingerprints."""
    out = np.zeros(len(pairs))
    todo: list[tuple[int, bytes, bytes]] = []
    for i, (x, y) in enumerate(pairs):
        if x == y:
            out[i] = 1
            continue
        (bx, *sx), (by, *sy) = x.split(":"), y.split(":")
        bx, by = int(bx), int(by)
        for p, s in ((bx, sx[0]), (2 * bx, sx[1])):
            for q, t in ((by, sy[0]), (2 * by, sy[1])):
                if p == q and _common_run(s := _squeezed(s), t := _squeezed(t)):
                    todo.append((i, s.encode(), t.encode()))
    if todo:
        d = distances([t[1] for t in todo], [t[2] for t in todo])
        longest = np.array([max(len(t[1]), len(t[2])) for t in todo])
        np.maximum.at(out, [t[0] for t in todo], 1 - d / longest)
    return out


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in _RESULT.split(", ")]
#: A document, or (is_last not null) the text of the first or last one of a range.
_SCHEMA = _RESULT + ", bucket int, is_last boolean, text string"


def _edited(text: str, after: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def compare(pairs: list[tuple[int | None, str, str]]) -> list[list]:
    """The result's columns for documents (doc_id, text, next text)."""
    own, after = [fingerprint(t.encode()) for _, t, _ in pairs], {}
    edits = [_edited(t, n) for _, t, n in pairs]
    changed = [fingerprint(e.encode()) for e in edits]
    for (_, t, _), f in zip(pairs, own, strict=True):
        after[t] = f
    following = [after[n] if n in after else fingerprint(n.encode()) for *_, n in pairs]
    near = [likeness(list(zip(own, x, strict=True))).tolist() for x in (changed, following)]
    return [[d for d, *_ in pairs], [len(t) for _, t, _ in pairs], [hashlib.sha256(e.encode()).hexdigest() for e in edits], own, changed, *near]


_KINDS = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range of documents in order: all but the last are compared with the next; the first and last are handed on."""
    bucket, before = TaskContext.get().partitionId(), None

    def handed(doc: int | None, text: str, is_last: bool) -> pa.RecordBatch:
        none = [pa.array([doc], pa.int64()), *(pa.array([None], k) for k in _KINDS[1:])]
        return pa.RecordBatch.from_arrays([*none, pa.array([bucket], pa.int32()), pa.array([is_last]), pa.array([text], pa.string())], [*_NAMES, "bucket", "is_last", "text"])

    for batch in slices(batches):
        rows = list(zip(column(batch, "doc_id").to_pylist(), texts(column(batch, "text")), strict=True))
        if before is None and rows:
            yield handed(*rows[0], False)
        rows = rows if before is None else [before, *rows]
        pairs = [(d, t, n) for (d, t), (_, n) in zip(rows, rows[1:], strict=False)]
        before, m = rows[-1] if rows else before, len(pairs)
        cols = [pa.array(c, k) for c, k in zip(compare(pairs), _KINDS, strict=True)]
        yield pa.RecordBatch.from_arrays([*cols, pa.nulls(m, pa.int32()), pa.nulls(m, pa.bool_()), pa.nulls(m, pa.string())], [*_NAMES, "bucket", "is_last", "text"])
    if before is not None:
        yield handed(*before, True)


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        pairs = list(zip(column(batch, "doc_id").to_pylist(), texts(column(batch, "text")), texts(column(batch, "after")), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(compare(pairs), _KINDS, strict=True)], _NAMES)


def in_order(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, text: each partition holds an ascending range of doc_id, nulls first, equal ids by text.

    Ranges are cut between rows of one doc_id too, where their texts begin differently.
    """
    docs = of_rows(docs, "doc_id", "text")
    keys = [F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 64).asc_nulls_first()]
    dealt = docs.repartitionByRange(ranges, *keys) if ranges else docs.repartitionByRange(*keys)
    return dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())


def compared(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and the likenesses to that and to the next document's.

    One range partitioning by doc_id; each range's last document meets the next
    range's first one in an equality join of two rows a range.  The rows are
    written once, as what is in a range must not be drawn anew.
    """
    rows, _ = written(in_order(docs, ranges).mapInArrow(_run, _SCHEMA), "piecewise")
    ends = rows.where("is_last is not null").select("bucket", "is_last", "doc_id", "text")
    turn = Window.orderBy("bucket")
    order = ends.where("not is_last").select("bucket", F.lead("bucket").over(turn).alias("then"), F.min("bucket").over(turn).alias("least"))
    order = order.select("bucket", F.coalesce("then", "least").alias("then"))
    heads = ends.where("not is_last").select(F.col("bucket").alias("then"), F.col("text").alias("after"))
    met = ends.where("is_last").join(order, "bucket").join(heads, "then").select("doc_id", "text", "after")
    return rows.where("is_last is null").select(*_NAMES).unionByName(met.mapInArrow(_meeting, _RESULT))
