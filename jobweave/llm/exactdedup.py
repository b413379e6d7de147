"""Operator 12: exact dedup by progressive refinement, with DataFrame functions only.

Texts are equal when they are identical after lower-casing A to Z.  Documents are
grouped by length, those of a shared length by the hash of their first
characters, those that share that as well by the hash of the whole text; only
these last have their content hashed.  A level tells the next scan which groups
are left through a bitmap of fixed size: its false positives cost a hash and
change no result, and neither texts nor groups have to be moved.  Documents then
move as a few numbers and a digest each.

Of equal texts the row with the largest doc_id stays; rows that repeat that
doc_id are the same document and stay together.  A null text counts as empty, a
null doc_id as smaller than any other: it stays only where all of its group are
null.  Texts are hashed whole, however long.  Groups are counted by partial
aggregation, and a large group's rows meet its one result row in a join that
adaptive execution can split.  An empty table gives no rows; further columns are
not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import of_rows, private, remove, written

#: Characters whose hash is the second level.
PREFIX = 256
#: A bitmap has two to this many bits (8 MB), in rows of 32,768.
FILTER_BITS = 26
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalized(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _place(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(1 << FILTER_BITS))


def _bitmap(groups: DataFrame, *keys: str) -> DataFrame:
    """bucket, bits: at most two to (FILTER_BITS - 15) rows of 4 KB, whatever the number of groups."""
    place = groups.select(_place(*keys).alias("place"))
    return place.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))


def _marked(rows: DataFrame, bitmap: DataFrame, *keys: str) -> DataFrame:
    """rows with shared: whether their group may be among those of the bitmap."""
    placed = rows.withColumn("place", _place(*keys)).withColumn("bucket", F.bitmap_bucket_number("place"))
    at = F.bitmap_bit_position("place").cast("int")
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.getbit(byte, F.pmod(at, F.lit(8))) == 1
    return placed.join(F.broadcast(bitmap), "bucket", "left").withColumn("shared", F.coalesce(bit, F.lit(False))).drop("place", "bucket", "bits")


def grouped(docs: DataFrame, carried: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept for each row; carried: further columns, over doc_id and text as they are."""
    spark, carried = docs.sparkSession, carried or {}
    text = normalized(F.col("text"))
    shape = {"size": F.octet_length(text), "head": F.xxhash64(F.substring(text, 1, PREFIX))}
    sizes, sizes_path = written(of_rows(docs, "text").select(*(c.alias(n) for n, c in shape.items())), "exactdedup-sizes")
    lengths, lengths_path = written(_bitmap(sizes.groupBy("size").agg(F.count("*").alias("n")).where("n > 1"), "size"), "exactdedup-lengths")
    heads = _marked(sizes, lengths, "size").where("shared").groupBy("size", "head").agg(F.count("*").alias("n")).where("n > 1")
    heads, heads_path = written(_bitmap(heads, "size", "head"), "exactdedup-heads")
    rows = _marked(of_rows(docs, "doc_id", "text").withColumns(shape), heads, "size", "head")
    digest = F.when(F.col("shared"), F.unhex(F.sha2(text.cast("binary"), 256)))
    rows, _ = written(rows.select("doc_id", "size", digest.alias("digest"), *(c.alias(n) for n, c in carried.items())), "exactdedup-rows")
    for path in (sizes_path, lengths_path, heads_path):
        remove(spark, path)
    # Written, so that the join has a shuffle of its own, which can be split where a group is large.
    same = rows.where("digest is not null").groupBy("size", "digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    same, _ = written(same, "exactdedup-groups")
    found = rows.join(same, ["size", "digest"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), *carried)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, all columns; where a doc_id has several texts, each is judged by itself."""
    key, sha = private(docs, "key", "sha")
    digest = F.sha2(normalized(F.col("text")).cast("binary"), 256)
    gone = grouped(docs, {"sha": digest}).where(~F.col("kept")).select(F.col("doc_id").alias(key), F.col("sha").alias(sha)).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone[key]) & (digest == gone[sha]), "left_anti")
