"""Repair of conversations against a search over all edits, and against its SQL."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import cache

import duckdb
from pyspark.sql import functions as F

from jobweave.llm import turnrepair
from jobweave.llm.common import table
from jobweave.llm.queries import ORACLE_SQL, op13_turnrepair
from tests.conftest import TESTDATA

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def damage(rows):
    out, known = defaultdict(list), set()
    for conv, turn, role, text in rows:
        known.add(conv)
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    return {conv: sorted(out[conv], key=order) for conv in known}


def cheapest(turns):
    """Every edit string, built turn by turn without a program over states: (cost, audit, lines) of the best for each role string so far."""

    @cache
    def best(i, roles):
        """From turn i on, roles being the initials so far (cut to what still matters)."""
        found = []
        if i == len(turns) and re.fullmatch("(s?(ua)+)?", roles):
            found.append((0, "", ()))
        if len(roles) < 2 * len(turns) + 4:
            for role in ("user", "assistant"):
                now = roles + role[0]
                if re.fullmatch("s?(ua)*u?", now) and inserted_in_a_row(now, i):
                    cost, audit, lines = best(i, now)
                    found.append((cost + 2, "I" + audit, (role + ":", *lines)))
        if i < len(turns):
            role, text, must_go, open_ = turns[i]
            cost, audit, lines = best(i + 1, roles)
            found.append((cost + 3, "D" + audit, lines))
            if not must_go:
                for edit, r, price in (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)):
                    if re.fullmatch("s?(ua)*u?", roles + r[:1]) and r:
                        cost, audit, lines = best(i + 1, roles + r[:1])
                        found.append((cost + price + open_, edit + audit, (f"{r}:{text}", *lines)))
        return min(found, default=(10**9, "", ()))

    def inserted_in_a_row(roles, i):
        return len(roles) <= 2 * i + 4

    return best(0, "")


def plain(rows):
    out = []
    for conv, turns in damage(rows).items():
        seen, marked, counts, illegal = set(), [], [0, 0, 0], 0
        for k, (_, role, text) in enumerate(turns):
            bare = text.rstrip(SPACE)
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            marked.append((role, text, fault in (0, 1), fault == 2))
            illegal += k > 0 and turns[k - 1][1][:1] + role[:1] not in ("su", "ua", "au")
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        cost, audit, lines = cheapest(tuple(marked))
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def made(rng, n):
    rows = []
    for conv in [None, *range(n)]:
        texts = ["Yes.", "no", "Why?\n", " \t\x0b", "", "é!", "a b c", None, "　"]
        for turn in range(rng.randint(0, 7)):
            rows.append((conv, rng.choice((turn, turn, turn, rng.randint(-3, 12), None)), rng.choice(("user", "assistant", "user", "assistant", "system", "tool", None, "a", "")), rng.choice(texts)))
    rng.shuffle(rows)
    return rows + rows[:20]


SCHEMA = "conv_id long, turn long, role string, text string"


def of(spark, rows, **more):
    turns = spark.createDataFrame(rows, SCHEMA).withColumns(more)
    return sorted((tuple(r) for r in turnrepair.summaries(turnrepair.damaged(turns)).collect()), key=str)


def test_against_a_search(spark):
    rows = made(random.Random(13), 400)
    assert of(spark, rows) == plain(rows)


def test_program_against_a_search():
    rng = random.Random(7)
    for _ in range(600):
        turns = [(rng.choice(("user", "assistant", "system", "tool", "u", "")), rng.choice("xyz"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 8))]
        repair = turnrepair.Repair()
        for role, text, must_go, open_ in turns:
            repair.turn(role, text.encode(), must_go, open_)
        cost, audit, lines = cheapest(tuple(turns))
        assert repair.result() == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_no_code_begins_another():
    assert not any(a != b and b.startswith(a) for a in turnrepair.CODES for b in turnrepair.CODES)


def test_repaired_turns(spark):
    turns = spark.createDataFrame(made(random.Random(5), 120), SCHEMA)
    rows = turnrepair.damaged(turns)
    out = defaultdict(list)
    for r in sorted(turnrepair.repaired(rows).collect(), key=lambda r: (str(r.conv_id), r.position)):
        assert r.position == len(out[r.conv_id]) + 1
        out[r.conv_id].append(r)
    for r in turnrepair.summaries(rows).collect():
        mine = out[r.conv_id]
        assert re.fullmatch("(s?(ua)+)?", "".join(t.role[0] for t in mine))
        assert "".join(t.edit for t in mine) == r.audit.replace("D", "")
        assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in mine).encode()).hexdigest() == r.repaired_sha256


def test_long_and_lost_conversations_and_clashing_columns(spark):
    """A conversation of 30,000 turns, a text of a million characters, one whose only turn is dropped."""
    lost = next(c for c in range(10_000, 11_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    long = [(1, i, ("user", "assistant")[i % 2], f"Turn {i}.") for i in range(30_000)]
    rows = [*long, (2, 0, "user", "x" * 1_000_000), (2, 1, "assistant", "Fine."), (lost, 0, "user", "Hello.")]
    got = {r[0]: r for r in of(spark, rows, gone=F.lit(None).cast("boolean"), kind=F.lit(3), n=F.lit(1), **{"a.b": F.lit(1)})}
    assert got[lost] == (lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    kinds = [zlib.crc32(f"1:{i}".encode()) % 20 for i in range(30_000)]
    assert got[1][2:5] == (kinds.count(1), kinds.count(3), kinds.count(2))
    assert len(got[1][7].replace("I", "")) == 30_000 - kinds.count(0) + kinds.count(3)
    assert of(spark, []) == []


def test_whole_table_against_sql(spark):
    sf, duck = f"{TESTDATA}/sf0.01", duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    got = op13_turnrepair(spark, sf)
    mine = sorted((tuple(r) for r in got.collect()), key=str)
    assert mine == plain([tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()])
    expected = duck.sql(ORACLE_SQL["op13_turnrepair"]).df()[got.columns].astype(object).values.tolist()
    assert mine == sorted(map(tuple, expected), key=str)
