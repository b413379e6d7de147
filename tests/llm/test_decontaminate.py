import random

from jobweave.llm import decontaminate as D


def distance(p, t):
    """Least edit distance of p to a substring of t, by dynamic programming."""
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p):
        new = [i + 1]
        for j, x in enumerate(t):
            new.append(min(row[j] + (c != x), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def brute(docs, items, rate=D.RATE):
    found = {}
    for doc, text in docs:
        for item, words in items:
            p = D.normal(words or "")
            if not p:
                continue
            k = int(len(p) * rate + 1e-9)  # a tenth of the bytes, whatever the length
            t = D.normal(text or "")
            if len(p) < D.KEY:
                if b" " + p + b" " in b" " + t + b" ":
                    found[doc, item] = 0
            elif (d := distance(p, t)) <= k:
                found[doc, item] = d
    return found


def edited(rng, text, n):
    text = list(text)
    for _ in range(n):
        i = rng.randrange(len(text))
        text[i : i + 1] = rng.choice(["", "q", text[i] + "z"])
    return "".join(text)


def fixture():
    rng = random.Random(5)
    words = ["stone", "the", "river", "and", "é", "walk", "night", "of", "under", "glass", "ten"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(rng.randrange(4, 40))) for i in range(12)] + [(90, "tiny"), (91, None), (92, ""), (93, "!!"), (94, "tiny")]
    docs = [(i, say(60) + (", " + edited(rng, rng.choice(items[:12])[1].upper(), rng.randrange(0, 14)) + ". " if i % 2 else " ") + say(30)) for i in range(60)]
    return docs + [(100, None), (101, ""), (102, "a tiny one"), (103, items[0][1]), (104, items[1][1] * 3)], items


def test_against_brute_force(spark):
    docs, items = fixture()
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    expected = brute(docs, items)
    assert len({v for v in expected.values()}) > 2
    assert {(r.doc_id, r.item_id): r.distance for r in D.matches(frame, bench).collect()} == expected
    assert {(r.doc_id, r.item_id): r.distance for r in D.matches(frame, bench, block_bytes=300).collect()} == expected  # many passes
    kept = {r.doc_id for r in D.clean(frame, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in expected}


def test_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "x" * 20, 0.5, "k"), (None, "y" * 20, None, None), (1, "x" * 20, 0.5, "k")], "doc_id long, text string, distance double, item_id string")
    bench = spark.createDataFrame([(7, "x" * 20, "z")], "item_id long, text string, doc_id string")
    assert [(r.doc_id, r.item_id) for r in D.matches(docs, bench).collect()] == [(1, 7), (1, 7)]
    assert D.clean(docs, bench).columns == docs.columns and D.clean(docs, bench).count() == 1
    assert D.matches(docs.limit(0), bench).count() == 0 and D.matches(docs, bench.limit(0)).count() == 0
    assert D.clean(docs, bench.limit(0)).count() == 3


def test_myers():
    rng = random.Random(1)
    for _ in range(200):
        p, t = (bytes(rng.choices(b"abc", k=rng.randrange(1, 90))) for _ in range(2))
        assert D.myers(p, t, len(p))[0] == min(distance(p, t), len(p) + 1)


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "lorem ipsum " * 200_000 + "the quick brown fox jumps over it")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "The quick, brown fox jumped over it")], "item_id long, text string")
    assert D.matches(docs, bench).first().distance == 2


def test_short_items(spark):
    """Items of 1 to 60 bytes have the whole budget of a tenth, pieces below eight bytes included."""
    rng = random.Random(12)
    say = lambda n: "".join(rng.choice("abcde fgh") for _ in range(n))
    items = [(n, ("x" + say(n) + "y")[: n - 1] + "z") for n in range(1, 61)]
    docs = []
    for i, (n, t) in enumerate(items * 2):
        docs.append((i, say(30) + " " + edited(rng, t, rng.randrange(0, 2 + n // 10)) + " " + say(30)))
    expected = brute(docs, items)
    assert {len(D.normal(dict(items)[x])) // 10 for _, x in expected} >= {0, 1, 2, 3, 4, 5}
    got = D.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): r.distance for r in got} == expected


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "it holds benchmark words", 2), (2, "it holds none", 3), (None, None, None)], ["doc_id", "text", "a.b"])
    bench = spark.createDataFrame([(None, "benchmark words"), (4, "  ")], "item_id long, text string")
    assert [tuple(r) for r in D.clean(docs, bench).orderBy("doc_id").collect()] == [(None, None, None), (2, "it holds none", 3)]


def test_first_of_equal_places():
    own = D.Items([D.normal("the river walks under glass")], 0.1)
    text = "a the river walks under glass b the river walks under glass"
    import pyarrow as pa

    assert own.matches(*D.normalised(pa.array([text]))) == {(0, 0): (0, 29)}
