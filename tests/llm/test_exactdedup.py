"""Exact dedup against a plain dictionary."""

import hashlib
import random
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from jobweave.llm import exactdedup
from jobweave.llm.common import table
from jobweave.llm.queries import ORACLE_SQL, op12_exactdedup
from tests.conftest import TESTDATA

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(LOWER)].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def of(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    digest = F.sha2(exactdedup.normalized(F.col("text")).cast("binary"), 256)
    return sorted((tuple(r) for r in exactdedup.grouped(docs.withColumns(more), {"sha": digest}).collect()), key=str)


def test_groups_against_a_dictionary(spark):
    rng = random.Random(12)
    texts = ["".join(rng.choice("aAbB é\n") for _ in range(rng.randint(0, 4))) for _ in range(300)]
    long = ["x" * 300_000 + tail for tail in ("y", "Y", "z", "zz")]  # one prefix, several contents
    same_head = [("q" * 256) + c * 10 for c in "abcAB"]
    rows = list(enumerate([*texts, *long, *same_head, None, "", "É", "é", "\U0001f600A", "\U0001f600a", "İ", "i̇"]))
    rng.shuffle(rows)
    assert of(spark, rows) == plain(rows)


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(None, "A"), (3, "a"), (3, "a"), (None, "lone"), (None, "null"), (None, "NULL"), (1, "other"), (2, None), (5, "")]
    assert of(spark, rows, size=F.lit(1), digest=F.lit("x"), kept=F.lit(0), **{"a.b": F.lit(2)}) == plain(rows)
    assert of(spark, []) == []


def test_filter_without_false_negatives(spark, monkeypatch):
    """Even a bitmap that is all ones, or of very few bits, changes nothing."""
    monkeypatch.setattr(exactdedup, "FILTER_BITS", 2)
    rows = [(i, f"text {i % 70}") for i in range(100)]
    assert of(spark, rows) == plain(rows)


def test_only_surviving_groups_are_hashed(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "cc"), (4, "dd"), (5, "DD")], "doc_id long, text string")
    shape = docs.select("doc_id", F.octet_length("text").alias("size"))
    marked = exactdedup._marked(shape, exactdedup._bitmap(shape.groupBy("size").count().where("count > 1"), "size"), "size")
    assert {r.doc_id for r in marked.where("shared").collect()} == {2, 3, 4, 5}


def test_the_rows_that_stay(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (2, "A", "y"), (1, "b", "z"), (None, "b", "w"), (None, "c", "v")], "doc_id long, text string, key string")
    assert sorted(exactdedup.deduplicated(docs).collect(), key=str) == sorted(docs.where("key in ('y', 'z', 'v')").collect(), key=str)


def test_whole_table(spark):
    sf = f"{TESTDATA}/sf0.001"
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    got = op12_exactdedup(spark, sf)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    expected = duck.sql(ORACLE_SQL["op12_exactdedup"]).df()[got.columns].astype(object).values.tolist()
    assert sorted(map(tuple, expected), key=str) == plain(rows)
