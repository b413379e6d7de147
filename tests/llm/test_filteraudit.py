"""The audit of filters against plain loops, and against its SQL."""

import itertools
import random
import re

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from jobweave.llm import filteraudit
from jobweave.llm.queries import ORACLE_SQL, op11_filteraudit
from tests.conftest import TESTDATA


def fails(rows):
    """The set of letters that each row fails, by the filters' definitions."""
    out = []
    for doc_id, _, text in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        got = {"A"} if len(words) < 200 else set()
        got |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        got |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text) else set()
        got |= {"D"} if re.search(r"[#$%&*|]", text) else set()
        got |= {"E"} if doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, _, t in rows) else set()
        out.append(got)
    return out


def plain(rows, labels):
    good, toxic = ({i for i, *label in labels if label[k] == 1} for k in (0, 1))
    failed, out = fails(rows), []
    for part in {s or "" for _, s, _ in rows}:
        mine = [(r[0], f) for r, f in zip(rows, failed) if (r[1] or "") == part]
        table, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order, 1):
                gone, left = [r for r in left if letter in r[1]], [r for r in left if letter not in r[1]]
                redundant = sum(letter in f and bool(f & set(order[: step - 1])) for _, f in mine)
                counts = [len(left), len(gone), redundant, sum(f == {letter} for _, f in mine), sum(i in good for i, _ in gone if i is not None), sum(i in toxic for i, _ in gone if i is not None)]
                table.append((part, "".join(order), step, letter, *counts))
                shapley[letter] += len(gone)
        out += [(*r[:3], *r[4:], shapley[r[3]]) for r in table]
    return sorted(out)


def made(rng):
    words = ["a", "b", "C", "Dd", "é", "#", " "]
    texts = [" ".join(rng.choice(words[: rng.randint(1, 7)]) for _ in range(rng.choice((0, 1, 3, 199, 200, 260)))) for _ in range(25)]
    texts += [" ".join(f"w{i}" for i in range(n)) for n in (199, 200, 201)] + [" ".join(f"w{i % 100}" for i in range(200)), " ".join(f"w{i % 99}" for i in range(200)), "\x0b\x0c\t", "x" * 98 + "AB", "x" * 97 + "ABC", "y" * 400_000, None, ""]
    rows = [(rng.choice((None, *range(40))), rng.choice((None, "", "s", "t.u")), rng.choice(texts)) for _ in range(260)]
    labels = [(rng.choice((None, *range(40))), rng.choice((0, 1, None)), rng.choice((0, 1, None))) for _ in range(50)]
    return [*rows, rows[0], rows[0]], labels


@pytest.mark.parametrize("block", (1, 5_000, 32 << 20))
def test_against_loops(spark, monkeypatch, block):
    monkeypatch.setattr(filteraudit, "BLOCK_BYTES", block)
    rows, labels = made(random.Random(block))
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({"mask": F.lit(1), "part": F.lit(2), "quality": F.lit(0)})
    got = filteraudit.audited(docs.repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit(0)))
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, labels)


def test_settled_in_tasks_with_colliding_hashes(monkeypatch):
    """All texts in one chain: results rest on the full texts."""
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda _: 7)
    rows = [(5, "s", b"x"), (3, "s", b"y"), (2, "s", b"x"), (4, "s", b"y"), (3, "s", b"y"), (None, "s", b"x"), (9, "s", b"x")]
    halves = [list(filteraudit._settle_blocks(part, ())) for part in (rows[:4], rows[4:])]
    got = filteraudit._settle_chains(sorted(itertools.chain(*halves), key=lambda r: filteraudit._order(r[0])), 1)
    assert sorted(got, key=str) == sorted([(5, "s", 1, 1), (2, "s", 0, 1), (9, "s", 1, 1), (None, "s", 0, 1), (3, "s", 0, 1), (3, "s", 0, 1), (4, "s", 1, 1)], key=str)


def test_copies_move_without_their_text():
    rows = [(i, "s", b"same text") for i in range(1000)]
    assert sum(text is not None for _, (_, _, text) in filteraudit._settle_blocks(rows, filteraudit.CHECKS)) == 1


def test_empty(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, source string, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filteraudit.audited(docs, labels).collect() == []


def test_whole_tables_against_sql(spark):
    sf, duck = f"{TESTDATA}/sf0.001", duckdb.connect()
    for t in ("documents", "labels"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = op11_filteraudit(spark, sf)
    expected = duck.sql(ORACLE_SQL["op11_filteraudit"]).df()[got.columns].astype(object).values.tolist()
    assert sorted(tuple(r) for r in got.collect()) == sorted(map(tuple, expected))
