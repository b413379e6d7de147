import hashlib
import math
import random
import re
from collections import Counter

from jobweave.llm import secrets as S

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 16]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(found)]


def texts():
    rng = random.Random(8)
    parts = ["password", "passwd", "SeCret", "token", "api_key", "apikey", "APIKEY", '"', "'", " ", "  ", ":", "=", "AKIA", "AKIAAKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "xyz", "é", "K", "ſ", "\n", "aGVsbG8gd29ybGQ+/=-_.", "q8Zr3Lk0PxV7mNc2TbY5"]
    return ["".join(rng.choices(parts, k=rng.randrange(1, 25))) for _ in range(400)] + ["", None, "é" * 30 + "AKIA" + "B7" * 9, "token = " + "a1" * 40]


def test_base_spans(spark):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r for r in S.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        expected = base(t or "")
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(",".join(expected).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("entropy")] == expected
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(e.startswith(k) for e in expected) for k in ("assign", "access", "hex"))


def test_entropy_windows():
    rng = random.Random(9)
    for _ in range(100):
        text, threshold = "".join(rng.choices("abcdef0123456789XYZ"[: rng.randrange(2, 20)], k=rng.randrange(10, 70))), rng.choice([2.0, 3.0, 3.5])
        covered = set()
        for i in range(len(text) - S.WINDOW + 1):
            window = text[i : i + S.WINDOW]
            if -sum(n / S.WINDOW * math.log2(n / S.WINDOW) for n in Counter(window).values()) >= threshold - 1e-9:
                covered |= set(range(i, i + S.WINDOW))
        assert {p for a, b in S.entropy_runs(text, threshold) for p in range(a, b)} == covered


def test_added_and_allowed(spark):
    secret = "q8Zr3Lk0PxV7mNc2TbY5Wd9Js"
    cases = {f"use {secret} now": 1, "123e4567-e89b-12d3-a456-426614174000": 0, "wordswithoutdigitsbutverylong": 0, "/usr/local/lib/python3/site-packages/x1": 0, f"key example{secret}": 0, "12345678901234567890123456": 0, f"https://{secret}": 0}
    got = S.scan(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).collect()
    assert [r.n_entropy for r in sorted(got)] == list(cases.values())
    assert S.scan(spark.createDataFrame([(1, f"use {secret}")], "doc_id long, text string"), allowed=("q8.*",)).first().spans == ""


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(None, "x", 1, "y")], "doc_id long, text string, n_hex int, spans string")
    assert S.scan(docs).first().n_hex == 0 and S.scan(docs.limit(0)).count() == 0


def test_candidates_in_urls(spark):
    key = "aB3xK9mQ2pL7vR4tY8wZ1n"
    assert list(S.candidates(f"http://localhost/{key}")) == [(17, key)]
    assert list(S.candidates(f"https://{key}@host/")) == [(8, key)]
    assert list(S.candidates(f"https://{key}/x")) == [] and list(S.candidates(f"https://{key} x")) == []
    assert list(S.candidates(f"https://me:{key}@host/")) == [(11, key)]
    rows = [(1, f"http://localhost/{key}"), (2, f"https://{key}/"), (3, "x " * 500_000 + f"http://localhost/{key}"), (3, None)]
    got = S.scan(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id", "spans").collect()
    assert [r.spans for r in got] == [f"entropy:17:{17 + len(key)}", "", "", f"entropy:1000017:{1000017 + len(key)}"]


def test_repeated_rows(spark):
    """Each row is scanned for itself, repeats included."""
    rows = [(1, "token = abcdefghij12"), (1, "token = abcdefghij12"), (2, "token = abcdefghij12"), (None, None), (None, None)]
    got = S.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.spans) for r in got) == [(0, ""), (0, ""), (1, "assign:0:20"), (1, "assign:0:20"), (2, "assign:0:20")]
