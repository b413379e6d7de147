"""Operator 11: how filters interact, over every order of applying them.

Each document gets a mask of the filters that it fails: some judge its text
alone, the last fails a text that a smaller doc_id has as well.  What any order
removes at any step follows from the number of documents of each mask.

Copies are found by a fingerprint-routed RDD.  A task chains the texts of a block
by their 64-bit hash, compares in full within a chain, and keeps one record a
text: its smallest doc_id.  Every other row is settled there and then, as a
smaller one is known.  The kept records are dealt out by hash and sorted by hash
and doc_id; the first record with a text has the smallest doc_id of all, further
ones aren't the smallest.  So a text goes once a block, however many copies there
are, and a task holds one block and one chain.  Settled rows move without text,
evenly over all tasks.  Labels are joined to (doc_id, part, mask) rows.
``combineByKey`` then merges vectors of counts by mask, one a part and task.

A null text counts as empty.  A row of null doc_id is no smaller and no larger
than another: it never fails as a copy, nor makes another fail.  Rows that repeat
a doc_id with its text count each, and none fails by another.  Labels that repeat
count once; a document has a label if any of its rows has it.  A null part counts
as the empty string.  Very long texts are judged whole, one at a time.  Empty
tables give no rows; further columns aren't read.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import of_rows

#: Bytes of text that a task chains before it sends them on.
BLOCK_BYTES = 32 << 20

#: Documents a task of the routed stage takes at most on average, however few partitions the session asks for.
ROWS = 300_000

#: A filter's letter, and whether a text (UTF-8) with these words fails it.
Check = tuple[str, Callable[[bytes, list[bytes]], bool]]
_SIGNS, _CAPITALS, _INNER = b"#$%&*|", bytes(range(ord("A"), ord("Z") + 1)), bytes(range(0x80, 0xC0))


def _few_words(text: bytes, words: list[bytes]) -> bool:
    return len(words) < 200


def _repetitive(text: bytes, words: list[bytes]) -> bool:
    return 100 * len(set(words)) < 50 * len(words)


def _shouting(text: bytes, words: list[bytes]) -> bool:
    characters = len(text) - len(text.translate(None, bytes(set(range(256)) - set(_INNER))))
    return 100 * (len(text) - len(text.translate(None, _CAPITALS))) > 2 * characters


def _signs(text: bytes, words: list[bytes]) -> bool:
    return len(text.translate(None, _SIGNS)) < len(text)


CHECKS: tuple[Check, ...] = (("A", _few_words), ("B", _repetitive), ("C", _shouting), ("D", _signs))
COPY = "E"
MASKS = "doc_id long, part string, mask int, n long"


def _settle_blocks(rows: Iterable[tuple], checks: tuple[Check, ...]) -> Iterator[tuple]:
    """((key, doc_id), (parts, mask, text)): a text's smallest doc_id of a block with its text, all other rows without."""
    copy, chains, size, turn = 1 << len(checks), {}, 0, itertools.count()

    def settled(doc_id: int | None, part: str, n: int, mask: int) -> tuple:
        return (next(turn), doc_id), ({part: n}, mask, None)

    def flushed() -> Iterator[tuple]:
        for fingerprint, chain in chains.items():
            for text, doc_id, parts, mask in chain:
                yield (fingerprint, doc_id), (parts, mask, text)
        chains.clear()

    for doc_id, part, text in rows:
        text = bytes(text)
        fingerprint = xxhash.xxh64_intdigest(text)
        link = next((x for x in chains.get(fingerprint, ()) if x[0] == text), None)
        if link is None:
            words = text.split()
            mask = sum(1 << i for i, (_, fails) in enumerate(checks) if fails(text, words))
            if doc_id is None:
                yield settled(None, part, 1, mask)
                continue
            chains.setdefault(fingerprint, []).append([text, doc_id, {part: 1}, mask])
            size += len(text)
            if size >= BLOCK_BYTES:
                yield from flushed()
                size = 0
        elif doc_id is None:
            yield settled(None, part, 1, link[3])
        elif doc_id > link[1]:
            yield settled(doc_id, part, 1, link[3] | copy)
        elif doc_id == link[1]:
            link[2][part] = link[2].get(part, 0) + 1
        else:
            for other, n in link[2].items():
                yield settled(link[1], other, n, link[3] | copy)
            link[1], link[2] = doc_id, {part: 1}
    yield from flushed()


def _settle_chains(records: Iterable[tuple], copy: int) -> Iterator[tuple]:
    """(doc_id, part, mask, n) from records in order of key and doc_id."""
    chain: list[tuple[bytes, int]] = []
    last = None
    for (key, doc_id), (parts, mask, text) in records:
        if text is not None:
            if key != last:
                chain, last = [], key
            first = next((smallest for known, smallest in chain if known == text), None)
            if first is None:
                chain.append((text, doc_id))
            elif first < doc_id:
                mask |= copy
        for part, n in parts.items():
            yield doc_id, part, mask, n


def _order(key: tuple) -> tuple:
    return key[0], key[1] is not None, key[1] or 0


def _partitions(docs: DataFrame) -> int:
    """The session's number, or more if the documents (counted from file footers) are many."""
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-of_rows(docs, "doc_id").count() // ROWS))


def masks(docs: DataFrame, part: str = "source", checks: tuple[Check, ...] = CHECKS, partitions: int | None = None) -> DataFrame:
    """doc_id, part, mask, n: what each row (n equal rows) fails; bit i is filter i, the bit above them a copy."""
    rows = of_rows(docs, "doc_id", part, "text").toDF("doc_id", "part", "text")
    rows = rows.select("doc_id", F.coalesce("part", F.lit("")), F.coalesce("text", F.lit("")).cast("binary"))
    records: RDD = rows.rdd.mapPartitions(partial(_settle_blocks, checks=checks))
    dealt = records.repartitionAndSortWithinPartitions(partitions or _partitions(docs), lambda key: key[0], keyfunc=_order)
    return docs.sparkSession.createDataFrame(dealt.mapPartitions(partial(_settle_chains, copy=1 << len(checks))), MASKS, verifySchema=False)


def _added(vector: np.ndarray, row: tuple) -> np.ndarray:
    mask, n, good, toxic = row
    vector[:, mask] += (n, n * good, n * toxic)
    return vector


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a += b
    return a


def _steps(vector: np.ndarray, letters: str) -> Iterator[tuple]:
    """A part's rows from its counts by mask: all, of good and of toxic documents."""
    mask = np.arange(vector.shape[1])
    out, removed_of = [], dict.fromkeys(letters, 0)
    for order in itertools.permutations(letters):
        earlier = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << letters.index(letter)
            fails, before = mask & bit != 0, mask & earlier != 0
            removed, good, toxic = (int(x) for x in vector[:, fails & ~before].sum(axis=1))
            kept = int(vector[0, ~fails & ~before].sum())
            out.append(("".join(order), step, letter, kept, removed, int(vector[0, fails & before].sum()), int(vector[0, bit]), good, toxic))
            removed_of[letter] += removed
            earlier |= bit
    for order, step, letter, *counts in out:
        yield order, step, *counts, removed_of[letter]


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audited(docs: DataFrame, labels: DataFrame, part: str = "source", checks: tuple[Check, ...] = CHECKS) -> DataFrame:
    """part, filter_order, step and counts, for each part, order of the filters and step.

    kept: documents left after the step; removed: failing its filter and none
    before; redundant: failing its filter and one before; unique_fails: failing
    its filter alone; good_lost, toxic_lost: removed ones labelled quality 1 and
    toxic 1; shapley: what its filter removes, summed over all orders.
    """
    letters, partitions = "".join(letter for letter, _ in checks) + COPY, _partitions(docs)
    label = lambda name: F.max(F.coalesce(F.col(name) == 1, F.lit(False)).cast("int")).alias(name)
    known = of_rows(labels, "doc_id", "quality", "toxic").where("doc_id is not null").groupBy("doc_id").agg(label("quality"), label("toxic"))
    rows = masks(docs, part, checks, partitions).join(known, "doc_id", "left").select("part", "mask", "n", F.coalesce("quality", F.lit(0)), F.coalesce("toxic", F.lit(0)))
    zeros = lambda row: _added(np.zeros((3, 2 << len(checks)), np.int64), row)
    vectors = rows.rdd.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(zeros, _added, _merged, partitions)
    found = vectors.flatMap(lambda kv: ((kv[0], *row) for row in _steps(kv[1], letters)))
    return docs.sparkSession.createDataFrame(found, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS), verifySchema=False)
