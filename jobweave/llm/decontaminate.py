"""Operator 1: benchmark decontamination by pigeonhole edit matching.

An item of n bytes may occur with up to k edits, k a tenth of n rounded down
(``RATE``).  It is split into k + 1 pieces: wherever it occurs with at most k
edits, one piece is intact.  Windows of eight bytes over the text are looked up
among the pieces' first bytes, those of shorter pieces (five bytes at least) by
as many bytes as they have.  The hits are verified up a tree over the pieces: a
node of p pieces may hold at most p - 1 edits (a node over budget in both halves
is over budget).  Nodes of up to 64 bytes are verified for all hits at once by
Myers' bit-parallel distance in 64-bit words, what is left by the same recurrence
in long integers, over the whole item.

Texts and items are compared in lower case, with each run of ASCII white space
and punctuation as one space; distance counts bytes of UTF-8.  Null and empty
texts match nothing; so do items without a letter or digit.  Items below eight
bytes must occur exactly, as words of their own.  Repeated rows of documents are
each judged; equal items under different ids are each reported.  Of several
places of an item the one of least distance counts, of equal ones the first.  A
very long text is searched whole, as a slice of its own.  Empty tables match
nothing.  Further columns pass through ``clean`` under whatever name.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, mapped, of_rows, slices, utf8

#: Edits allowed, as a share of the item's bytes.
RATE = 0.1
KEY = 8
#: Bytes of items in one pass over the documents; further items take further passes.
BLOCK_BYTES = 8 << 20
#: Hits that are verified at once.
HITS = 4096

_TABLE = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))


def normalised(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts in lower case with single spaces, each text between spaces."""
    data, offsets = utf8(pc.utf8_lower(pc.fill_null(array, "")))
    data = np.frombuffer(data.tobytes().translate(_TABLE), np.uint8)
    space = data == 32
    gone = np.flatnonzero(space[1:] & space[:-1]) + 1
    gone = gone[~np.isin(gone, offsets)]
    keep = np.ones(len(data), bool)
    keep[gone] = False
    return data[keep], offsets - np.searchsorted(gone, offsets)


def normal(text: str) -> bytes:
    data, _ = normalised(pa.array([text]))
    return data.tobytes().strip(b" ")


def myers(pattern: bytes, text: bytes, most: int) -> tuple[int, int]:
    """Least edit distance of pattern to a substring of text, and where the first such one ends; most + 1 if above."""
    m = len(pattern)
    peq: dict[int, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, last = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, at = full, 0, m, most + 1, -1
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        score += bool(ph & last) - bool(mh & last)
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
        if score < best:
            best, at = score, j + 1
    return best, at


class Items:
    """The pieces of a block of items, and their trees; both in flat arrays."""

    def __init__(self, patterns: list[bytes], rate: float) -> None:
        self.patterns = patterns
        self.lengths = np.array([len(p) for p in patterns], np.int64)
        self.budget = np.where(self.lengths < KEY, 0, (self.lengths * rate + 1e-9).astype(np.int64))
        self.data = np.frombuffer(b"".join(patterns) + bytes(KEY), np.uint8)
        self.begins = np.cumsum(self.lengths) - self.lengths
        many = self.budget + 1
        self.item = np.repeat(np.arange(len(patterns)), many)
        turn = np.arange(len(self.item)) - np.repeat(np.cumsum(many) - many, many)
        cut = lambda i: self.lengths[self.item] * i // many[self.item]
        self.start = cut(turn)
        self.size = cut(turn + 1) - self.start
        # Nodes of 2, 4, ... pieces about each piece, as far as they fit 64 bytes.
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for level in range(1, 6):
            first = turn >> level << level
            last = np.minimum(many[self.item], first + (1 << level))
            at, length = cut(first), cut(last) - cut(first)
            fits = (length <= 64) & (last - first > 1)
            if not fits.any():
                break
            self.nodes.append((at, np.where(fits, length, 0), last - first - 1))
        windows = np.ndarray((max(1, len(self.data) - KEY + 1),), "<u8", self.data, strides=(1,))
        place = self.begins[self.item] + self.start
        self.tail = windows[place + np.maximum(self.size - KEY, 0)]
        self.classes = []
        for size in range(1, KEY + 1):
            own = np.flatnonzero(np.minimum(self.size, KEY) == size)
            if not len(own):
                continue
            mask = np.uint64((1 << 8 * size) - 1)
            key = windows[place[own]] & mask
            order = np.argsort(key, kind="stable")
            bits = max(16, int(len(own) * 8).bit_length())
            seen = np.zeros(1 << bits, bool)
            seen[self.hashed(key, bits)] = True
            self.classes.append((mask, bits, seen, key[order], own[order]))

    @staticmethod
    def hashed(keys: np.ndarray, bits: int) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)

    def hits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, piece) of each piece's occurrences in data."""
        n = len(data)
        windows = np.ndarray((n,), "<u8", np.append(data, np.zeros(KEY, np.uint8)), strides=(1,))
        places, pieces = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a in range(0, n, 1 << 18):
            part = windows[a : a + (1 << 18)].copy()
            for mask, bits, seen, keys, own in self.classes:
                masked = part & mask
                at = np.flatnonzero(seen[self.hashed(masked, bits)])
                if not len(at):
                    continue
                masked = masked[at]
                low, high = np.searchsorted(keys, masked, "left"), np.searchsorted(keys, masked, "right")
                many = high - low
                at, low = np.repeat(at + a, many), np.repeat(low, many)
                many = many[many > 0]
                piece = own[low + np.arange(len(low)) - np.repeat(np.cumsum(many) - many, many)]
                size = self.size[piece]
                good = (at + size <= n) & ((size < KEY) | (windows[np.minimum(at + np.maximum(size - KEY, 0), n - 1)] == self.tail[piece]))
                places.append(at[good])
                pieces.append(piece[good])
        return np.concatenate(places), np.concatenate(pieces)

    def passes(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, piece: np.ndarray, level: int) -> np.ndarray:
        """Whether the pieces' nodes occur within their budgets: Myers' distance in 64-bit words for all hits at once; start, end: the windows of data."""
        at, length, edits = (x[piece] for x in self.nodes[level])
        one = np.uint64(1)
        peq = np.zeros((len(piece), 256), np.uint64)
        row = np.repeat(np.arange(len(piece)), length)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
        letter = self.data[(self.begins[self.item[piece]] + at)[row] + inner]
        np.bitwise_or.at(peq, (row, letter), one << inner.astype(np.uint64))
        last = one << (length - 1).astype(np.uint64)
        pv = np.full(len(piece), np.uint64(0xFFFFFFFFFFFFFFFF))
        mv = np.zeros(len(piece), np.uint64)
        score, best, every = length.copy(), length.copy(), np.arange(len(piece))
        for j in range(int((end - start).max(initial=0))):
            inside = start + j < end
            eq = peq[every, data[np.minimum(start + j, len(data) - 1)]]
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv), pv & xh
            score = score + ((ph & last) != 0) - ((mh & last) != 0)
            best = np.where(inside & (score < best), score, best)
            ph, mh = ph << one, mh << one
            pv, mv = mh | ~(xv | ph), ph & xv
        return best <= edits

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> dict[tuple[int, int], tuple[int, int]]:
        """(row, item) -> (distance, end of the match in the row's bytes)."""
        found: dict[tuple[int, int], tuple[int, int]] = {}
        if not len(self.patterns) or not len(data):
            return found
        at, piece = self.hits(data)
        row = np.searchsorted(offsets, at, "right") - 1
        good = at + self.size[piece] <= offsets[row + 1]
        at, piece, row = at[good], piece[good], row[good]
        # Items below eight bytes are one piece, and stand between spaces.
        tiny = self.lengths[self.item[piece]] < KEY
        end = at + self.size[piece]
        alone = ((at == offsets[row]) | (data[at - 1] == 32)) & ((end == offsets[row + 1]) | (data[np.minimum(end, len(data) - 1)] == 32))
        for r, x, e in sorted(zip(row[tiny & alone].tolist(), self.item[piece[tiny & alone]].tolist(), end[tiny & alone].tolist(), strict=True)):
            found.setdefault((r, x), (0, e - int(offsets[r])))
        at, piece, row = at[~tiny], piece[~tiny], row[~tiny]
        for level, (places, lengths, edits) in enumerate(self.nodes):
            keep = np.ones(len(at), bool)
            some = np.flatnonzero(lengths[piece] > 0)
            for a in range(0, len(some), HITS):
                own = some[a : a + HITS]
                p = piece[own]
                begin = at[own] - self.start[p] + places[p]
                start = np.maximum(begin - edits[p], offsets[row[own]])
                end = np.minimum(begin + lengths[p] + edits[p], offsets[row[own] + 1])
                keep[own] = self.passes(data, start, end, p, level)
            at, piece, row = at[keep], piece[keep], row[keep]
        number = self.item[piece]
        begin = at - self.start[piece]
        windows: dict[tuple[int, int], list[list[int]]] = {}
        for i in np.lexsort((begin, number, row)).tolist():
            r, x = int(row[i]), int(number[i])
            k = int(self.budget[x])
            a, b = max(int(begin[i]) - k, int(offsets[r])), min(int(begin[i]) + len(self.patterns[x]) + k, int(offsets[r + 1]))
            own = windows.setdefault((r, x), [])
            if own and a <= own[-1][1] and b - own[-1][0] <= 2 * (b - a):
                own[-1][1] = max(b, own[-1][1])
            else:
                own.append([a, b])
        for (r, x), own in windows.items():
            pattern, k = self.patterns[x], int(self.budget[x])
            for a, b in own:
                here = data[a:b].tobytes()
                exact = here.find(pattern)
                distance, end = (0, exact + len(pattern)) if exact >= 0 else myers(pattern, here, k)
                if distance <= k and distance < found.get((r, x), (k + 1,))[0]:
                    found[r, x] = (distance, a + end - int(offsets[r]))
        return found


#: Built pieces of the blocks that a worker has met last, by the block's name.
_BUILT: dict[tuple[str, float], Items] = {}


def _items(block: tuple[str, Broadcast], rate: float) -> Items:
    """A block's pieces, built once a worker."""
    key = (block[0], rate)
    if key not in _BUILT:
        if len(_BUILT) >= 2:
            _BUILT.clear()
        _BUILT[key] = Items([p for _, p in block[1].value], rate)
    return _BUILT[key]


def _blocks(docs: DataFrame, items: DataFrame, block_bytes: int) -> Iterator[tuple[str, Broadcast]]:
    """A name for each block, and a broadcast of its (item_id, normal text), each of about ``block_bytes``."""
    items = of_rows(items, "item_id", "text").where("text is not null").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        yield uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast([(r.item_id, p) for r in rows if (p := normal(r.text))])


def matches(docs: DataFrame, items: DataFrame, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, distance, budget, match_end: one row for each document and item that it holds.

    match_end is in bytes of the normalised text.  The items go to the executors
    in blocks of about ``block_bytes``, one pass over the documents for each.
    """
    rows, out = of_rows(docs, "doc_id", "text"), None
    for block in _blocks(docs, items, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            own = _items(block, rate)
            for batch in slices(batches):
                found = sorted((r, x, *v) for (r, x), v in own.matches(*normalised(column(batch, "text"))).items())
                rows = pa.array([f[0] for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [column(batch, "doc_id").take(rows), pa.array([block[1].value[f[1]][0] for f in found], pa.int64()), *(pa.array(x, pa.int64()) for x in ([f[2] for f in found], [int(own.budget[f[1]]) for f in found], [f[3] for f in found]))],
                    ["doc_id", "item_id", "distance", "budget", "match_end"],
                )

        part = rows.mapInArrow(run, "doc_id long, item_id long, distance long, budget long, match_end long")
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, items: DataFrame, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns, that hold no item.

    Rows with a null doc_id are judged as the others: the verdict is made on the
    text beside each row, without a join.
    """
    place, schema = docs.columns.index("text"), docs.schema
    for block in _blocks(docs, items, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            own = _items(block, rate)
            for batch in slices(batches):
                keep = np.ones(batch.num_rows, bool)
                keep[[r for r, _ in own.matches(*normalised(batch.column(place)))]] = False
                yield batch.filter(pa.array(keep))

        docs = mapped(docs, run, schema)
    return docs
