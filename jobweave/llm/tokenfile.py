"""Operator 7: token ids in a compressed binary file.

An adaptive range coder codes the ids of independently reset blocks.  A block's
model mixes three predictions of the next id.  Order 2 and order 1 each name the
id that last followed their context, with a confidence (order 2 checks a hash of
its context); order 0 counts ids.  The weights of the mixture are learnt within
the block, one for each pair of confidences.  At its start a block's order 0 has
the counts of its segment, which the segment's head states; the rest is empty.
Blocks are checksummed, so each can be read, and trusted, alone.

The coder works on all blocks of a segment in lockstep, one NumPy operation for
all of them; carries are settled when the blocks end.

A file is a Parquet folder of segments, so that any store Spark writes to will
do: ``bucket`` and ``part`` order the segments, ``n_ids`` counts, ``payload`` is

    magic JWT3 | documents, ids, block length, different ids (u32 each) | CRC-32 of what follows to the blocks
    ids by falling count (u16 each) | eighths of the logarithm of their counts, base 2 (u8 each)
    doc_id (i64 each) | null flag (u8 each) | ids of each document (u32 each)
    for each block: words (u32), CRC-32 of its ids (u32)
    the blocks' 16-bit words, little-endian

Documents come in ascending doc_id, nulls first, equal ids by text; each ends with the end id.  Null and empty texts have the end id alone.  Repeated
rows are each written.  Special tokens in a text are what the library makes of
them.  A very long text lies in one segment.  Ids must be below 65536.  An empty
table gives a file without segments.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import col

from .common import SLICE_BYTES, column, gather, of_rows, scratch, slices, utf8
from .piecewise import in_order

MAGIC = b"JWT3"
#: Ids of a block; blocks that are coded in lockstep; slots of a block for order 2.
BLOCK, LANES, TABLE = 1024, 4096, 1024
#: Cells of all tables of one kind that a worker holds.
CELLS = 6_000_000
#: Sum of the counts that order 0 starts with; what an id adds; after how many ids they are summed anew.
PRIOR, STEP, FRESH = 1 << 15, 24, 256
#: Weights move by this power of two towards what came true.
RATE = 5
#: A character that is a token by itself.
MARK = "|"
#: The pattern of words for which a run of ASCII letters is one word.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Chunks of text that a worker keeps with their ids.
KEPT = 400_000


class Model:
    """The adaptive models of ``m`` blocks, in lockstep.  Ids are ranks in the segment's table of ids.

    The next id's interval is split by weights learnt in the block for each pair
    of confidences: the order-2 prediction's part, the order-1 prediction's, and
    the rest by order 0.  Order 0 starts from the segment's counts and adds the
    block's own, at steps that double and then every ``FRESH`` ids; so the sum of
    all counts is one number for all blocks, and counts are added a block at a time.
    """

    def __init__(self, m: int, prior: np.ndarray) -> None:
        d = self.d = len(prior)
        rows = np.arange(m)
        self.one, self.mix = rows * d, rows * 128
        self.slots = np.stack([rows * TABLE, (m + rows) * TABLE])
        self.count = np.empty((m, d), np.int32)
        self.count[:] = prior
        self.weights = self.count.ravel()
        # Where each id's part ends; then every sixteenth of these, and so on until sixteen are left.
        self.ends = [np.full((m, -(-d // 16) * 16), _PAD)]
        while self.ends[-1].shape[1] > 16:
            self.ends.append(np.full((m, -(-self.ends[-1].shape[1] // 256) * 16), _PAD))
        self.rows = [rows * (e.shape[1] // 16) for e in self.ends]
        self.t = 0
        self.total = int(prior.sum())
        self.ends[0][:, :d] = np.cumsum(prior)
        self.coarser()
        # Slots of order 1, then of order 2, hold an id (16 bits), its confidence (3) and a check of the context (12).
        self.seen = np.zeros(2 * m * TABLE, np.int32)
        sure = np.arange(128) & 63
        first = np.minimum(700 + 420 * np.arange(8), 3500)
        second = np.where(sure >> 3 > 0, first[sure >> 3], 0)
        lesser = np.where((sure & 7 > 0) & (np.arange(128) < 64), first[sure & 7], 0)
        # Both weights in one number: order 2's, and order 1's above it.
        self.trust = np.tile((second | lesser << 12).astype(np.int32), m)
        self.last, self.before = np.zeros(m, np.int64), np.zeros(m, np.int64)

    def coarser(self) -> None:
        for fine, coarse in zip(self.ends, self.ends[1:], strict=False):
            coarse[:, : fine.shape[1] // 16] = fine[:, 15::16]

    def due(self) -> bool:
        return self.t % FRESH == 0 or self.t in (32, 64, 128)

    def add(self, ids: np.ndarray) -> None:
        """Add the ids since the last time, a row a step, to order 0."""
        n = ids.shape[1]
        np.add.at(self.weights, (ids.T + self.one[:n, None]).ravel(), np.int32(STEP))
        np.cumsum(self.count, axis=1, out=self.ends[0][:, : self.d])
        self.coarser()
        self.total += STEP * len(ids)

    def parts(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the parts of ids, a row a step, begin in order 0, and how wide they are."""
        n, row = ids.shape[1], 16 * self.rows[0]
        wide = self.weights.take(ids.T + self.one[:n, None])
        low = self.ends[0].ravel().take(ids.T + row[:n, None]) - wide
        return np.ascontiguousarray(low.T), np.ascontiguousarray(wide.T)

    def predict(self, n: int) -> None:
        """Both predictions, and how 4096 parts are split."""
        last = self.last[:n]
        context = last * 0x9E3779B1 + self.before[:n] * 0x85EBCA77
        at, check = self.at, self.check = np.empty((2, n), np.int64), np.empty((2, n), np.int32)
        np.bitwise_and(last, TABLE - 1, out=at[0])
        check[0] = last >> _TABLE_BITS
        np.bitwise_and(context >> 16, TABLE - 1, out=at[1])
        check[1] = context >> 32
        check[1] &= 0xFFF
        at += self.slots[:, :n]
        met = self.met = self.seen.take(at)
        said = self.said = met & 0xFFFF
        sure = self.sure = (met >> 16 & 7) * (met >> 19 == check)
        named = self.named = sure > 0
        same = (said[0] == said[1]) & named[1]
        self.usable = named[0] & ~same
        self.place = self.mix[:n] + ((sure[1] << 3) + sure[0] + (same.view(np.int8).astype(np.int32) << 6))
        p = self.trust.take(self.place)
        first, one = self.p = p & 0xFFF, p >> 12
        second = (4096 - first) * one >> 12
        self.rest = (4096 - first - second).astype(np.float64)
        self.upper, self.middle = first * float(self.total), second * float(self.total)
        self.both = self.upper + self.middle
        self.room = 4096.0 * self.total

    def span(self, ids: np.ndarray, low: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids lie among ``room``, and how wide, given their parts in order 0."""
        one = (self.said[0] == ids) & self.usable & (self.middle > 0)
        two = (self.said[1] == ids) & self.named[1] & (self.upper > 0)
        start = np.where(one, self.upper, self.both + self.rest * low)
        start *= ~two
        return start, np.where(two, self.upper, np.where(one, self.middle, self.rest * wide))

    def find(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids that lie at these places, where they begin, and how wide they are."""
        two = at < self.upper
        ids, start, size = np.where(two, self.said[1], self.said[0]), self.upper * ~two, np.where(two, self.upper, self.middle)
        some = np.flatnonzero(at >= self.both)
        if len(some):
            both, rest = self.both[some], self.rest[some]
            x = ((at[some] - both) / rest).astype(np.int32)
            found = np.zeros(len(some), np.int64)
            for ends, rows in zip(self.ends[::-1], self.rows[::-1], strict=True):
                # Of sixteen ends, how many are passed: eight truths a word, summed in its highest byte.
                passed = (ends.reshape(-1, 16).take(rows[some] + found, axis=0) <= x[:, None]).view(np.uint64)
                found = (found << 4) + ((passed[:, 0] + passed[:, 1]) * _ONES >> _56).view(np.int64)
            wide = self.weights.take(self.one[some] + found)
            low = self.ends[0].ravel().take(16 * self.rows[0][some] + found) - wide
            ids[some] = found
            start[some] = both + rest * low
            size[some] = rest * wide
        return ids, start, size

    def update(self, ids: np.ndarray) -> None:
        n = len(ids)
        sure, met = self.sure, self.met
        right = (self.said == ids) & self.named
        two, one = self.p
        goal = right.view(np.int8).astype(np.int32) * 4095
        two = two + ((goal[1] - two) >> RATE)
        one = one + ((goal[0] * self.usable - one) >> RATE) * ~right[1]
        self.trust[self.place] = two | one << 12
        other = np.where(sure > 1, met - ((sure + 1 >> 1) << 16), self.check << 19 | (ids | 1 << 16))
        self.seen[self.at] = np.where(right, met + ((sure < 7).view(np.int8).astype(np.int32) << 16), other)
        self.before[:n] = self.last[:n]
        self.last[:n] = ids
        self.t += 1


_PAD, _ONES, _56 = np.int32(2**31 - 1), np.uint64(0x0101010101010101), np.uint64(56)
_TABLE_BITS = TABLE.bit_length() - 1
#: The coder's numbers are whole ones below 2^53 in float64: an interval is renewed below the first, a word lies above the second.
_RENEW, _WORD, _SHIFT, _WHOLE = 2.0**36, 2.0**32, 2.0**16, 2.0**48
#: Ids of a block at most; above, an interval could be narrower than the counts.
_LONGEST = 1 << 19


def _group(d: int) -> int:
    """How many blocks are coded at once: their tables have ``CELLS`` cells at most."""
    return max(16, min(LANES, CELLS // max(d, TABLE)))


def _prior(sizes: np.ndarray) -> np.ndarray:
    """Counts at the start of a block, from a byte for each id: eighths of the logarithm of its count in the segment."""
    share = np.exp2(sizes.astype(np.float64) / 8)
    return np.maximum(1, np.floor(share * (PRIOR / max(share.sum(), 1.0)))).astype(np.int64)


def _compress(ids: np.ndarray, block: int, prior: np.ndarray) -> list[np.ndarray]:
    m = -(-len(ids) // block)
    tokens = np.zeros((m, block), np.int32)
    tokens.ravel()[: len(ids)] = ids
    steps = np.ascontiguousarray(tokens.T)
    tail = len(ids) - (m - 1) * block
    model = Model(m, prior)
    low, wide = np.zeros(m), np.full(m, _WHOLE)
    out = np.zeros((m, 2 * block + 8), np.uint32)
    words, begins = out.ravel(), np.arange(m) * out.shape[1]
    at = begins.copy()
    n_steps, since = block if m > 1 else tail, 0
    for t in range(n_steps):
        if not t or model.due():
            if t:
                model.add(steps[since:t])
            since, until = t, min(n_steps, next(i for i in (32, 64, 128, (t // FRESH + 1) * FRESH) if i > t))
            low_0, wide_0 = model.parts(steps[t:until])
        n = m if t < tail else m - 1
        now = steps[t, :n]
        model.predict(n)
        start, size = model.span(now, low_0[t - since, :n], wide_0[t - since, :n])
        r = np.floor(wide[:n] / model.room)
        low[:n] += r * start
        wide[:n] = size * r
        model.update(now)
        while len(who := np.flatnonzero(wide[:n] < _RENEW)):
            value, to = low[who], at[who]
            word = np.floor(value / _WORD)
            words[to] = word
            at[who] = to + 1
            low[who] = (value - word * _WORD) * _SHIFT
            wide[who] *= _SHIFT
    # A multiple of a word lies in every interval; the words after it are zero, and not written.
    words[at] = np.ceil(low / _WORD)
    used = at + 1 - begins
    for j in range(int(used.max()) - 1, 0, -1):  # carries
        out[:, j - 1] += out[:, j] >> np.uint32(16)
        out[:, j] &= np.uint32(0xFFFF)
    return [out[i, : used[i]].astype("<u2") for i in range(m)]


def _expand(words: np.ndarray, sizes: np.ndarray, count: int, block: int, prior: np.ndarray) -> np.ndarray:
    m = len(sizes)
    held = np.zeros((m, max(3, int(sizes.max())) + 2), np.uint16)
    held[np.arange(held.shape[1]) < sizes[:, None]] = words
    held, at = held.ravel(), np.arange(m) * held.shape[1]
    code = (held[at] * _WORD) + held[at + 1] * _SHIFT + held[at + 2]
    at += 3
    tail = count - (m - 1) * block
    model, wide = Model(m, prior), np.full(m, _WHOLE)
    out, since = np.zeros((block, m), np.int32), 0
    for t in range(block if m > 1 else tail):
        if t and model.due():
            model.add(out[since:t])
            since = t
        n = m if t < tail else m - 1
        model.predict(n)
        r = np.floor(wide[:n] / model.room)
        found, start, size = model.find(np.minimum(np.floor(code[:n] / r), model.room - 1))
        code[:n] -= r * start
        wide[:n] = size * r
        out[t, :n] = found
        model.update(found)
        while len(who := np.flatnonzero(wide[:n] < _RENEW)):
            to = at[who]
            code[who] = code[who] * _SHIFT + held.take(to, mode="clip")
            at[who] = to + 1
            wide[who] *= _SHIFT
    return out.T.ravel()[:count]


def compress(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[int]]:
    """The segment's table of ids, a byte of count for each, and for each block of ids its words and checksum."""
    if block > _LONGEST:
        raise ValueError(f"a block has {_LONGEST} ids at most")
    counts = np.bincount(ids)
    table = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
    place = np.zeros(len(counts), np.int64)
    place[table] = np.arange(len(table))
    sizes, rank = np.round(8 * np.log2(counts[table])).astype(np.uint8), place[ids]
    prior, words, at_once = _prior(sizes), [], _group(len(table)) * block
    for a in range(0, len(ids), at_once):
        words += _compress(rank[a : a + at_once], block, prior)
    sums = [zlib.crc32(ids[i : i + block].astype("<u4").tobytes()) for i in range(0, len(ids), block)]
    return table, sizes, words, sums


def expand(table: np.ndarray, counts: np.ndarray, words: np.ndarray, sizes: np.ndarray, sums: np.ndarray, count: int, block: int) -> np.ndarray:
    """The ids of all blocks; a wrong checksum is an error."""
    prior, group, out = _prior(counts), _group(len(table)), []
    ends = np.concatenate([[0], np.cumsum(sizes)])
    for a in range(0, len(sizes), group):
        b = min(a + group, len(sizes))
        rank = _expand(words[ends[a] : ends[b]], sizes[a:b], min(count, b * block) - a * block, block, prior)
        out.append(table[np.minimum(rank, len(table) - 1)])
    ids = np.concatenate(out) if out else np.zeros(0, np.int64)
    for i, wanted in enumerate(sums.tolist()):
        if zlib.crc32(ids[i * block : (i + 1) * block].astype("<u4").tobytes()) != wanted:
            raise ValueError(f"block {i} fails its checksum")
    return ids


def pack(docs: list[int | None], sizes: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    table, counts, words, sums = compress(ids, block)
    index = table.astype("<u2").tobytes() + counts.tobytes()
    index += np.array([d or 0 for d in docs], "<i8").tobytes() + np.array([d is None for d in docs], np.uint8).tobytes() + sizes.astype("<u4").tobytes() + np.array([[len(w), s] for w, s in zip(words, sums, strict=True)], "<u4").tobytes()
    return MAGIC + np.array([len(docs), len(ids), block, len(table), zlib.crc32(index)], "<u4").tobytes() + index + b"".join(w.tobytes() for w in words)


def unpack(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, how many ids each has, the ids."""
    if payload[:4] != MAGIC:
        raise ValueError("not a segment of token ids")
    n, count, block, d, crc = np.frombuffer(payload, "<u4", 5, 4).tolist()
    m = -(-count // block)
    at = 24 + 3 * d
    end = at + 13 * n + 8 * m
    if zlib.crc32(payload[24:end]) != crc:
        raise ValueError("a segment's index fails its checksum")
    table, counts = np.frombuffer(payload, "<u2", d, 24).astype(np.int64), np.frombuffer(payload, np.uint8, d, 24 + 2 * d)
    docs, nulls = np.frombuffer(payload, "<i8", n, at), np.frombuffer(payload, np.uint8, n, at + 8 * n)
    sizes, blocks = np.frombuffer(payload, "<u4", n, at + 9 * n), np.frombuffer(payload, "<u4", 2 * m, at + 13 * n).reshape(-1, 2)
    ids = expand(table, counts, np.frombuffer(payload, "<u2", offset=end), blocks[:, 0].astype(np.int64), blocks[:, 1], count, block)
    return [None if z else d for d, z in zip(docs.tolist(), nulls.tolist(), strict=True)], sizes.astype(np.int64), ids


class Tokens:
    """Ids of texts by a tokenizer of the tokenizers library that drops white space.

    Chunks between white space are tokenized once and kept; the result is as if
    whole texts were, as its pattern has no match across white space.  A full stop
    or comma between an ASCII letter and white space, or the end, is a chunk of its
    own, as no match holds a letter and one of these.  Of chunks
    in ASCII alone the lower-case form is kept, and goes to a tokenizer without
    the normalizer, which has nothing to do there, and of letters alone to one
    without the pattern ``WORDS``, which finds them whole.  Chunks with ``<|`` stay as
    they are, since special tokens are matched before letters are lowered.
    """

    def __init__(self, definition: str, end: int) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(definition)
        parts = json.loads(definition)
        self.lowers = _lowers(parts.get("normalizer"))
        self.simple = Tokenizer.from_str(json.dumps({**parts, "normalizer": None})) if self.lowers else self.whole
        bare = {**parts, "normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}}
        self.bare = Tokenizer.from_str(json.dumps(bare)) if self.lowers and _by_words(parts.get("pre_tokenizer")) else self.simple
        (self.mark,) = self.whole.encode(MARK, add_special_tokens=False).ids
        self.end, self.printable = end, re.compile("[!-{}~]+").fullmatch  # without the mark
        self.number = {"": 0, " ": 1}  # what is left of white space; the end of a text, which no chunk is
        self.ids, self.starts, self.sizes = np.array([end], np.int64), np.array([0, 0]), np.array([0, 1])
        self.uses = np.full(2, KEPT)  # in how many blocks each chunk was met

    def forget(self) -> None:
        """Keep half as many chunks as may be kept, those that most blocks had."""
        stay = np.sort(np.argsort(-self.uses, kind="stable")[: KEPT // 2])
        chunks = np.array(list(self.number), object)[stay].tolist()
        self.number = dict(zip(chunks, range(len(chunks)), strict=True))
        sizes = self.sizes[stay]
        self.ids = gather(self.ids, self.starts[stay], sizes)
        self.starts, self.sizes, self.uses = np.cumsum(sizes) - sizes, sizes, self.uses[stay] >> 1
        self.uses[:2] = KEPT

    def learn(self, new: list[str]) -> None:
        """Tokenize new chunks, many to a text, told apart by a mark that none of these holds."""
        ids, sizes = [], np.zeros(len(new), np.int64)
        bare, simple, rest = [], [], []
        for i, w in enumerate(new):
            (rest if not self.printable(w) else bare if w.isalpha() else simple).append(i)
        plain = [i for i in rest if MARK not in new[i]]
        odd = [i for i in rest if MARK in new[i]]
        mark = f" {MARK} "
        for tokenizer, of in ((self.bare, bare), (self.simple, simple), (self.whole, plain)):
            groups = [of[i : i + 256] for i in range(0, len(of), 256)]
            for group, e in zip(groups, tokenizer.encode_batch_fast([mark.join(new[i] for i in g) + mark for g in groups], add_special_tokens=False), strict=True):
                flat = np.array(e.ids, np.int64)
                ends = np.flatnonzero(flat == self.mark)
                sizes[group] = np.diff(ends, prepend=-1) - 1
                ids.append(flat[flat != self.mark])
        for i, e in zip(odd, self.whole.encode_batch_fast([new[i] for i in odd], add_special_tokens=False), strict=True):
            sizes[i] = len(e.ids)
            ids.append(np.array(e.ids, np.int64))
        order = np.array(bare + simple + plain + odd, np.int64)
        starts = np.empty(len(new), np.int64)
        starts[order] = len(self.ids) + np.cumsum(sizes[order]) - sizes[order]
        self.starts, self.sizes, self.ids = np.concatenate([self.starts, starts]), np.concatenate([self.sizes, sizes]), np.concatenate([self.ids, *ids])
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])

    def encode(self, block: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id, and how many each has."""
        if len(self.number) > KEPT:
            self.forget()
        data, offsets = utf8(block)
        bound = np.zeros(len(data) + 1, bool)
        bound[1:] = _SPACE[data]
        bound[offsets] = True
        stops = np.flatnonzero(_STOP[data])
        stops = stops[bound[stops + 1] | _SPACE[data[np.minimum(stops + 1, len(data) - 1)]]]
        bound[stops[_LETTER[data[stops - 1]]]] = True
        cut = np.flatnonzero(bound)
        pieces = pa.LargeStringArray.from_buffers(len(cut) - 1, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        chunks = pc.utf8_rtrim(pieces.dictionary, " \n\t\r")
        if self.lowers:
            free = pc.and_not(pc.string_is_ascii(chunks), pc.match_substring(chunks, "<|"))
            chunks = pc.if_else(free, pc.ascii_lower(chunks), chunks)
        number, new = self.number, []
        chunks = chunks.to_numpy(zero_copy_only=False)
        known = list(map(number.get, chunks))
        for i in [i for i, n in enumerate(known) if n is None]:
            w = chunks[i]
            n = number.get(w)
            if n is None:
                n = number[w] = len(number)
                new.append(w)
            known[i] = n
        if new:
            self.learn(new)
        known = np.array(known, np.int64)
        self.uses[known] += 1
        at = known[pieces.indices.to_numpy()]
        words = np.searchsorted(cut, offsets[1:])
        at = np.insert(at, words, 1)
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)[words + np.arange(len(words))]
        return gather(self.ids, self.starts[at], sizes), np.diff(ends, prepend=0)


#: The last tokenizer of this worker with its chunks; a worker's later tasks go on with them.
_HELD: dict[tuple[str, int], Tokens] = {}


def _tokens(definition: str, end: int) -> Tokens:
    if (definition, end) not in _HELD:
        _HELD.clear()
        _HELD[definition, end] = Tokens(definition, end)
    return _HELD[definition, end]


_SPACE, _STOP = np.isin(np.arange(256), list(b" \n\t\r")), np.isin(np.arange(256), list(b".,"))
_LETTER = np.isin(np.arange(256) | 32, np.arange(ord("a"), ord("z") + 1)) & (np.arange(256) < 128)


def _lowers(normalizer: dict | None) -> bool:
    """Whether all that a normalizer does to printable ASCII is to lower its letters."""
    steps = normalizer.get("normalizers", [normalizer]) if normalizer else []
    idle = lambda step: step["type"] in ("NFC", "NFKC", "NFD", "NFKD") or (step["type"], step.get("pattern")) == ("Replace", {"Regex": r"\s+"})
    return any(s["type"] == "Lowercase" for s in steps) and all(s["type"] == "Lowercase" or idle(s) for s in steps)


def _by_words(split: dict | None) -> bool:
    """Whether a pre-tokenizer is ``WORDS`` and then bytes as characters, which leaves ASCII letters as they are."""
    steps = split.get("pretokenizers", []) if split else []
    return [(s["type"], s.get("pattern"), s.get("behavior"), s.get("invert"), s.get("add_prefix_space"), s.get("use_regex")) for s in steps] == [("Split", {"Regex": WORDS}, "Removed", True, None, None), ("ByteLevel", None, None, None, False, False)]


def write(docs: DataFrame, definition: str, path: str, end: int = 2, block: int = BLOCK, lanes: int = LANES) -> None:
    """Write the ids of all documents, in ascending doc_id order, to path."""
    held = docs.sparkSession.sparkContext.broadcast(definition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokens, bucket, part = _tokens(held.value, end), TaskContext.get().partitionId(), 0
        docs_in, sizes_in, ids_in, count = [], [], [], 0

        def segment() -> pa.RecordBatch:
            payload = pack(docs_in, np.concatenate(sizes_in), np.concatenate(ids_in), block)
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([part], pa.int32()), pa.array([count], pa.int64()), pa.array([payload])], ["bucket", "part", "n_ids", "payload"])

        for batch in slices(batches, limit=min(SLICE_BYTES, lanes * block)):
            ids, sizes = tokens.encode(column(batch, "text"))
            docs_in += column(batch, "doc_id").to_pylist()
            sizes_in.append(sizes), ids_in.append(ids)
            count += len(ids)
            if count >= lanes * block:
                yield segment()
                part += 1
                docs_in, sizes_in, ids_in, count = [], [], [], 0
        if docs_in:
            yield segment()

    in_order(docs).mapInArrow(run, "bucket int, part int, n_ids long, payload binary").write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """bucket, part, doc_id, start (within the segment), n_tokens, ids_crc32, ids: all documents of a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, part, payload in zip(*(column(batch, c) for c in ("bucket", "part", "payload")), strict=True):
                docs, sizes, ids = unpack(payload.as_py())
                ends = np.concatenate([[0], np.cumsum(sizes)])
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                n = len(docs)
                yield pa.RecordBatch.from_arrays([pa.array([bucket.as_py()] * n, pa.int32()), pa.array([part.as_py()] * n, pa.int32()), pa.array(docs, pa.int64()), pa.array(ends[:-1]), pa.array(sizes), pa.array(crc, pa.int64()), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))], ["bucket", "part", "doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return spark.read.parquet(path).select("bucket", "part", "payload").mapInArrow(run, "bucket int, part int, doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>")


def positions(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, read back from a file.

    Where segments begin is a running sum in two levels, over one row a bucket and
    over each bucket's segments; their sizes are a column of the file.
    """
    files = spark.read.parquet(path).select("bucket", "part", "n_ids")
    whole = files.groupBy("bucket").agg(F.sum("n_ids").alias("n"))
    whole = whole.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - col("n")).alias("upto"))
    inner = F.sum("n_ids").over(Window.partitionBy("bucket").orderBy("part")) - col("n_ids")
    starts = files.withColumn("inner", inner).join(whole, "bucket").select("bucket", "part", (col("upto") + col("inner")).alias("before"))
    rows = read(spark, path).drop("ids").join(starts, ["bucket", "part"])
    return rows.select("doc_id", (col("before") + col("start")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, definition: str, end: int = 2) -> DataFrame:
    """Write all documents to a new file in the shared folder and read it back."""
    docs = of_rows(docs, "doc_id", "text")
    path = scratch(docs.sparkSession, "token-ids")
    write(docs, definition, path, end)
    return positions(docs.sparkSession, path)
