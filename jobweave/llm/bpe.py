"""Operator 3: byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct words of a block of documents form one array of byte symbols.  An
inverted index leads from each mergeable pair to its positions; a heap holds
the ranks that occur.  Every merge is applied in rank order to all its
positions at once, and touches the two neighbours of each only, whose new pairs
enter the index.  A merge that makes a pair of lower rank hands over to that
one first, as merging word by word would.  The documents' ids are then gathered
from the words'.

Words already replayed by a worker are kept (up to ``KEPT`` of them), so common
words are replayed once.  Null and empty texts have no ids.  Rows with a null
doc_id are encoded as others, repeated rows each.  A very long text is a block of
its own.  Pairs of equal rank in a word merge from the left.  An empty table
gives an empty one.  Further columns pass through under whatever name.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType

from .common import column, gather, mapped, named, of_rows, slices, texts

#: Words that a worker keeps with their ids.
KEPT = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line for each token, base 64 and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.pair: dict[tuple[int, int], int] = {}  # filled as pairs are met; -1: no token
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        size = max(self.token, default=-1) + 1
        self.sizes = np.array([len(self.token.get(i, b"")) for i in range(size)], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(self.token.get(i, b"") for i in range(size)), np.uint8)

    def rank(self, left: int, right: int) -> int:
        found = self.pair.get((left, right))
        if found is None:
            if len(self.pair) > 4_000_000:
                self.pair.clear()
            found = self.pair[left, right] = self.ranks.get(self.token[left] + self.token[right], -1)
        return found

    def decode(self, ids: np.ndarray) -> bytes:
        return gather(self.bytes, self.starts[ids], self.sizes[ids]).tobytes()


def replay(words: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words, one after the other, and how many each has."""
    sizes = np.array([len(w) for w in words], np.int64)
    raw = np.frombuffer(b"".join(words), np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64), sizes
    # A stop symbol after each word; no pair holds it.
    stops = np.cumsum(sizes + 1) - 1
    inside = np.ones(len(raw) + len(words), bool)
    inside[stops] = False
    first = np.full(len(inside), -1, np.int64)
    first[inside] = vocabulary.byte[raw]
    symbol = first.tolist()
    after = list(range(1, len(symbol) + 1))
    before = list(range(-1, len(symbol) - 1))
    index: dict[int, list[int]] = {}
    # The first pairs by their distinct values, with NumPy; positions ascend.
    both = (first[:-1] << 32) | first[1:]
    good = np.flatnonzero((first[:-1] >= 0) & (first[1:] >= 0))
    order = good[np.argsort(both[good], kind="stable")]
    cuts = np.flatnonzero(np.diff(both[order])) + 1
    for own in np.split(order, cuts) if len(order) else []:
        rank = vocabulary.rank(symbol[own[0]], symbol[own[0] + 1])
        if rank >= 0:
            index.setdefault(rank, []).extend(own.tolist())
    heap = sorted(index)
    rank_of, token = vocabulary.rank, vocabulary.pair
    while heap:
        rank = heappop(heap)
        places = index.pop(rank, None)
        if places is None:
            continue
        places.sort()
        lower = False
        for turn, i in enumerate(places):
            left = symbol[i]
            if left < 0:
                continue
            j = after[i]
            right = symbol[j]
            if right < 0:
                continue
            found = token.get((left, right))
            if found is None:
                found = rank_of(left, right)
            if found != rank:
                continue
            symbol[i], symbol[j] = rank, -2
            k = after[j]
            after[i] = k
            if k < len(before):
                before[k] = i
                if (s := symbol[k]) >= 0:
                    found = token.get((rank, s))
                    if found is None:
                        found = rank_of(rank, s)
                    if found >= 0:
                        own = index.get(found)
                        if own is None:
                            index[found] = [i]
                            heappush(heap, found)
                        else:
                            own.append(i)
                        lower |= found < rank
            h = before[i]
            if h >= 0 and (s := symbol[h]) >= 0:
                found = token.get((s, rank))
                if found is None:
                    found = rank_of(s, rank)
                if found >= 0:
                    own = index.get(found)
                    if own is None:
                        index[found] = [h]
                        heappush(heap, found)
                    else:
                        own.append(h)
                    lower |= found < rank
            if lower and turn + 1 < len(places):
                rest = index.setdefault(rank, [])
                rest.extend(places[turn + 1 :])
                heappush(heap, rank)
                break
    out = np.array(symbol, np.int64)
    ids = out[out >= 0]
    # Ids before each stop, hence each word's number of them.
    upto = np.cumsum(out >= 0)[stops]
    return ids, np.diff(upto, prepend=0)


class Encoder:
    """Encodes blocks of texts; keeps the words it has met."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, kept: int = KEPT) -> None:
        self.vocabulary, self.find, self.kept = Vocabulary(ranks), regex.compile(pattern).findall, kept
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, block: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        if len(self.number) > self.kept:
            self.clear()
        found = [self.find(t) for t in block]
        number, new = self.number, []
        at = []
        for words in found:
            for w in words:
                n = number.get(w)
                if n is None:
                    n = number[w] = len(number)
                    new.append(w)
                at.append(n)
        if new:
            ids, sizes = replay([w.encode() for w in new], self.vocabulary)
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
            self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
            self.sizes = np.concatenate([self.sizes, sizes])
        at = np.array(at, np.int64)
        sizes = self.sizes[at]
        words = np.array([len(w) for w in found], np.int64)
        ends = np.cumsum(np.concatenate([[0], sizes]))[np.cumsum(words)]
        return gather(self.ids, self.starts[at], sizes), np.diff(ends, prepend=0)


def encoded(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """All columns of docs but text, and ids (array of int), in place of a column of that name."""
    docs = docs.select(*[named(c) for c in docs.columns if c.lower() != "ids"])
    place, kept = docs.columns.index("text"), [c for c in docs.columns if c != "text"]
    held = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(held.value, pattern)
        for batch in slices(batches):
            ids, sizes = encoder.encode(texts(batch.column(place)))
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != place), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))], [*kept, "ids"])

    return mapped(docs, run, docs.select(*map(named, kept)).schema.add("ids", ArrayType(IntegerType())))


def decoded(rows: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """All columns of rows but ids, and text, in place of a column of that name: the ids' bytes as UTF-8, invalid parts replaced.

    A null array of ids gives a null text; an id without a token is an error.
    """
    rows = rows.select(*[named(c) for c in rows.columns if c.lower() != "text"])
    place, kept = rows.columns.index("ids"), [c for c in rows.columns if c != "ids"]
    held = rows.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(held.value)
        for batch in batches:
            found = [None if ids is None else vocabulary.decode(np.array(ids, np.int64)).decode("utf-8", "replace") for ids in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != place), pa.array(found, pa.string())], [*kept, "text"])

    return mapped(rows, run, rows.select(*map(named, kept)).schema.add("text", "string"))


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: of the ids, and of the bytes they decode to; with_ids: also ids."""
    held = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(held.value, pattern)
        vocabulary = encoder.vocabulary
        for batch in slices(batches):
            ids, sizes = encoder.encode(texts(column(batch, "text")))
            raw, data = ids.astype("<u4").tobytes(), vocabulary.decode(ids)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            lengths = np.concatenate([[0], np.cumsum(vocabulary.sizes[ids])])[ends].tolist()
            cuts = (4 * ends).tolist()
            sha = lambda b, cuts: pa.array([hashlib.sha256(b[x:y]).hexdigest() for x, y in zip(cuts, cuts[1:], strict=False)], pa.string())
            out = {"doc_id": column(batch, "doc_id"), "n_tokens": pa.array(sizes), "ids_sha256": sha(raw, cuts), "decoded_sha256": sha(data, lengths)}
            if with_ids:
                out["ids"] = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return of_rows(docs, "doc_id", "text").mapInArrow(run, schema)
