"""Verified links among items that meet in signature bands.

Both searches by minima (lines, documents) share this: an item has a name of 128
bits and a key for each band; the items of one key are a bucket; links are
verified by exact Jaccard likeness within buckets.

A bucket of one item goes; equal buckets count once, by a hash of their members.
A filter says which items are in any bucket, so only their contents are shuffled,
each once; it has eight bits a member up to ``MOST_BITS`` (8 MB), beyond which it
lets more contents through, to the same result.

A bucket of more than ``limit`` items is dealt out in blocks, each with the
bucket's pivots (its least items in ``PIVOTS`` orders).  The links so verified
give components; each large bucket has a main one, its largest.  Every item
outside it then meets all items of the bucket, in tiles of a block and a side.  A
pair that met in a bucket is therefore verified, or both are in the main
component, joined already.  So components don't depend on ``limit``.  A family of
near items costs its size; items outside a large bucket's largest family cost
their number times the bucket's, in tiles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, column
from .components import components

LIKENESS = 0.8
LIMIT, PIVOTS = 2000, 8
#: Bits of the filter, as powers of two.
LEAST_BITS, MOST_BITS = 16, 26
#: Items of one key that a task holds; of further ones it holds none.
HELD = 1 << 17

#: Links (indices) from the members of each component to its first item, and each item's first.
Near = Callable[[list[bytes]], tuple[list[int], list[int], np.ndarray]]


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, name) sorted by both: the members of keys with several names, under a hash of their set.

    A key with more than ``HELD`` names passes through under its own value.
    """
    held = np.zeros((0, 2), np.int64)
    passing = None

    def distinct(rows: np.ndarray) -> np.ndarray:
        return rows[np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])] if len(rows) else rows

    def settled(rows: np.ndarray) -> pa.RecordBatch:
        new = np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(rows)))
        x = rows[:, 1].view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        sums = np.add.reduceat(x * np.uint64(0x9E3779B97F4A7C15), starts).view(np.int64)
        some = np.repeat(sizes > 1, sizes)
        return out(np.repeat(sums, sizes)[some], rows[some, 1])

    def out(bucket: np.ndarray, name: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(name)], ["bucket", "h1"])

    for batch in batches:
        rows = np.stack([column(batch, "key").to_numpy(), column(batch, "h1").to_numpy()], axis=1)
        if passing is not None:
            own = rows[:, 0] == passing
            if own.any():
                yield out(rows[own, 0], rows[own, 1])
            rows = rows[~own]
            if not len(rows):
                continue
            passing = None
        rows = distinct(np.concatenate([held, rows]))
        if not len(rows):
            continue
        last = int(np.searchsorted(rows[:, 0], rows[-1, 0]))  # rows are sorted as signed longs
        if last:
            yield settled(rows[:last])
        held = rows[last:]
        if len(held) > HELD:
            passing = held[0, 0]
            yield out(held[:, 0], held[:, 1])
            held = held[:0]
    if len(held):
        yield settled(held)


def joined(item: np.ndarray, element: np.ndarray, n: int, likeness: float = LIKENESS) -> tuple[list[int], list[int], np.ndarray]:
    """Links among n sets by exact Jaccard likeness, as ``Near``; item, element: which set holds what, repeats allowed."""
    _, flat = np.unique(element, return_inverse=True)
    many = int(flat.max(initial=0)) + 1
    item, flat = np.divmod(np.unique(item * many + flat), many)
    sizes = np.bincount(item, minlength=n)
    starts = np.cumsum(sizes) - sizes
    mark, first = np.zeros(many, bool), np.arange(n)
    rest, a, b = np.ones(n, bool), [], []
    for root in range(n):
        if not rest[root]:
            continue
        rest[root] = False
        todo = [root]
        while todo and rest.any():
            at = todo.pop()
            own = flat[starts[at] : starts[at] + sizes[at]]
            mark[own] = True
            could = np.flatnonzero(rest & (sizes >= likeness * sizes[at] - 1e-9) & (sizes * likeness <= sizes[at] + 1e-9))
            if len(could):
                if 2 * len(could) > n:
                    shared = np.add.reduceat(mark[flat], starts, dtype=np.int64)[could]
                else:
                    some = sizes[could]
                    begins = np.cumsum(some) - some
                    shared = np.add.reduceat(mark[flat[np.repeat(starts[could] - begins, some) + np.arange(int(some.sum()))]], begins, dtype=np.int64)
                linked = could[shared >= likeness * (sizes[could] + sizes[at] - shared) - 1e-9].tolist()
                a += linked
                b += [root] * len(linked)
                first[linked] = root
                rest[linked] = False
                todo += linked
            mark[own] = False
    return a, b, first


_LINK = "a1 long, a2 long, b1 long, b2 long"


def _verified(batches: Iterator[pa.RecordBatch], near: Near) -> Iterator[pa.RecordBatch]:
    """Links between the near items of each bucket and tile, from rows sorted by these."""
    held: dict[tuple[int, int], bytes] = {}
    now, out = None, [[] for _ in range(4)]

    def settle() -> None:
        who = list(held)
        a, b, _ = near(list(held.values()))
        for j, side in enumerate((a, b)):
            for k in (0, 1):
                out[2 * j + k].extend([who[i][k] for i in side])

    def batch_of() -> pa.RecordBatch:
        done = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["a1", "a2", "b1", "b2"])
        for c in out:
            c.clear()
        return done

    for batch in batches:
        for bucket, tile, h1, h2, item in zip(*(column(batch, c).to_pylist() for c in ("bucket", "tile", "h1", "h2", "item")), strict=True):
            if now != (bucket, tile):
                if len(held) > 1:
                    settle()
                held, now = {}, (bucket, tile)
            held[h1, h2] = item
        if len(out[0]) > 10_000:
            yield batch_of()
    if len(held) > 1:
        settle()
    yield batch_of()


def filtered(name: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which of these names (128 bits in two columns) a filter may hold."""
    at = name[:, 0] & (32 * len(bits) - 1)
    return np.flatnonzero(bits[at >> 5] >> (at & 31).astype(np.uint32) & 1)


def links(keys: DataFrame, contents: Callable[[Broadcast], DataFrame], near: Near, limit: int = LIMIT) -> DataFrame:
    """a, b: pairs of names (h1, h2) that join the near items of each component of a bucket.

    keys: h1 and an array keys of each item, repeats allowed.  contents: given a
    filter, the items (h1, h2, item) that it may hold, repeats allowed.
    """
    spark = keys.sparkSession
    members = keys.select("h1", F.explode("keys").alias("key")).repartition("key").sortWithinPartitions("key", "h1").mapInArrow(_buckets, "bucket long, h1 long")
    members = checkpoint(members.distinct())

    # A bit for each value that a member's name can have, in words of 32 bits.
    power = min(MOST_BITS, max(LEAST_BITS, (8 * members.count()).bit_length()))
    place = F.col("h1").bitwiseAND(F.lit((1 << power) - 1))
    words = members.select(F.shiftright(place, 5).alias("word"), F.expr("shiftleft(1L, int(h1 & 31))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    bits = np.zeros(1 << (power - 5), np.uint32)
    bits[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    found = contents(spark.sparkContext.broadcast(bits)).groupBy("h1", "h2").agg(F.first("item").alias("item"))

    turns = [F.lit(int(c)) for c in np.random.default_rng(5).integers(-(1 << 63), (1 << 63) - 1, PIVOTS)]
    large = members.groupBy("bucket").agg(F.count("*").alias("n"), *(F.min(F.col("h1").bitwiseXOR(t)).alias(f"p{i}") for i, t in enumerate(turns))).where(f"n > {limit}")
    large = checkpoint(large.select("bucket", F.ceil(F.col("n") / limit).cast("int").alias("blocks"), F.array(*(F.col(f"p{i}").bitwiseXOR(t) for i, t in enumerate(turns))).alias("pivots")))
    some = not large.isEmpty()
    block = F.pmod(F.xxhash64("h1"), F.col("blocks")).cast("int")
    if some:
        members = checkpoint(members.join(large, "bucket", "left"))
        tiles = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).when(F.array_contains("pivots", F.col("h1")), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(block))
        rows = members.select("bucket", "h1", F.explode(tiles).alias("tile"))
        found = checkpoint(found)
    else:
        rows = members.select("bucket", "h1", F.lit(0).alias("tile"))

    def verified(rows: DataFrame) -> DataFrame:
        rows = rows.join(found, "h1").select("bucket", "tile", "h1", "h2", "item")
        out = checkpoint(rows.repartition("bucket", "tile").sortWithinPartitions("bucket", "tile", "h1", "h2").mapInArrow(lambda batches: _verified(batches, near), _LINK))
        name = lambda x: F.struct(F.col(f"{x}1").alias("h1"), F.col(f"{x}2").alias("h2")).alias(x)
        return out.select(name("a"), name("b"))

    out = verified(rows)
    if not some:
        return out
    # Items of large buckets with their component so far; one without a link is a component of its own.
    inside = members.where("blocks is not null").select("bucket", "h1", "blocks").join(found.select("h1", "h2"), "h1")
    of = components(out).select("node.h1", "node.h2", "component")
    inside = checkpoint(inside.join(of, ["h1", "h2"], "left").select("bucket", "blocks", "h1", F.coalesce("component", F.struct("h1", "h2")).alias("component")))
    sizes = checkpoint(inside.groupBy("bucket", "component").agg(F.count("*").alias("n")))
    main = checkpoint(sizes.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most")))
    main = main.where("most < n").select("bucket", "main", F.ceil((F.col("n") - F.col("most")) / limit).cast("int").alias("sides"))
    rest = checkpoint(inside.join(main, "bucket"))
    if rest.isEmpty():
        return out
    side = F.pmod(F.xxhash64(F.lit(1), "h1"), F.col("sides")).cast("int")
    every = rest.select("bucket", "h1", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("side"), block.alias("block"), "blocks")
    alone = rest.where("component <> main").select("bucket", "h1", side.alias("side"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "blocks")
    tile = (F.col("side").cast("long") * F.col("blocks") + F.col("block")).alias("tile")
    return out.unionByName(verified(every.unionByName(alone).select("bucket", "h1", tile).distinct()))
