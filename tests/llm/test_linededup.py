import random

from jobweave.llm import linededup as L


def plain(rows):
    """doc_id -> numbers of the lines that go, by comparing all lines."""
    occurrences = sorted((d, th, n, L.normal(x)) for d, th, t in rows for n, x in enumerate((t or "").split("\n")) if L.normal(x))
    sets = {}
    for *_, x in occurrences:
        padded = x if len(x) >= 8 else x.ljust(8, b"\0")
        sets[x] = {padded[i : i + 8] for i in range(len(padded) - 7)}
    names, parent = list(sets), {x: x for x in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    seen, gone = set(), {}
    for d, _, n, x in occurrences:
        if root(x) in seen:
            gone.setdefault(d, set()).add(n)
        seen.add(root(x))
    return gone


def corpus():
    rng = random.Random(2)
    words = ["stone", "river", "and", "walk", "night", "under", "glass", "ten", "ölig"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [say(25) for _ in range(30)]
    docs = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            line = rng.choice(base) if rng.random() < 0.6 else say(25)
            if rng.random() < 0.5:
                line = line.replace("stone", "Stone", 1).replace("ten", "tens", 1)
            parts.append(rng.choice(["", "  "]) + line)
        docs.append((i, "\n".join([*parts, "", "ok"] if i % 5 == 0 else parts)))
    return docs


def test_against_all_pairs(spark):
    docs = spark.createDataFrame([*corpus(), (100, None), (101, ""), (102, "ok\nok\r\n OK "), (None, "ok")], "doc_id long, text string").selectExpr("doc_id", "text", "xxhash64(text) th")
    rows = [(-1 if r.doc_id is None else r.doc_id, r.th, r.text) for r in docs.collect()]
    expected = plain([r for r in rows if r[2] is not None])
    for limit in (L.LIMIT, 4):  # whole buckets, and blocks
        got = {-1 if r.doc_id is None else r.doc_id: set(r.lines) for r in L.dropped(docs.drop("th"), limit).collect()}
        assert got == expected


def test_texts_and_columns(spark):
    rows = [(1, "one line here\nanother of them", "x", 7), (2, "One line here\n\nthird line of text", "y", 8), (3, "another of them", "z", 9), (4, None, None, None), (5, "", "w", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines string, n_chars long")
    got = {r.doc_id: r for r in L.deduplicated(docs).collect()}
    assert got[2].text == "\nthird line of text" and (got[2].n_lines, got[2].n_dropped) == (2, 1) and got[4].text is None and got[5].n_lines == 0
    left = {r.doc_id: r for r in L.remaining(docs.drop("n_lines")).collect()}
    assert set(left) == {1, 2, 4, 5} and left[2].n_chars == len("\nthird line of text") and left[1].n_chars == 7
    assert L.deduplicated(docs.limit(0)).count() == 0


def test_repeated_rows_count_as_one(spark):
    docs = spark.createDataFrame([(1, "same text of a row")] * 3, "doc_id long, text string")
    assert [r.n_dropped for r in L.deduplicated(docs).collect()] == [0, 0, 0]


def test_columns_of_any_name(spark):
    rows = [(1, "one line here\nanother of them", 1, 2, 3, 4), (2, "One line here\nthird line of text", 5, 6, 7, 8), (3, "another of them", 9, 9, 9, 9)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "a.b", "th", "gone_lines", "n_lines"])
    got = {r.doc_id: r for r in L.remaining(docs).collect()}
    assert L.remaining(docs).columns == docs.columns and set(got) == {1, 2}
    assert (got[2].text, got[2]["a.b"], got[2].th, got[2].n_lines) == ("third line of text", 5, 6, 8)


def test_long_text_and_empty_tables(spark):
    rng = random.Random(1)
    lines = ["".join(rng.choice("abcdefghijklmnop ") for _ in range(90)).strip() for _ in range(50_000)]
    docs = spark.createDataFrame([(1, "\n".join([*lines, "xy" * 300_000])), (2, lines[7] + "\n" + "xy" * 300_000), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in L.remaining(docs).collect()}
    assert set(got) == {1, 3}
    assert L.remaining(docs.limit(0)).count() == 0 and L.deduplicated(docs.where("doc_id = 3")).first().n_lines == 0


def test_measured_recall():
    """Pairs of whole likeness 0.8 to 0.9 meet in a band about as often as the formula says."""
    rng, met, wanted = random.Random(4), 0, 0.0
    for _ in range(400):
        base = "".join(rng.choice("abcdefgh ") for _ in range(300)).strip()
        at = rng.randrange(250)
        other = base[:at] + "".join(rng.choice("uvwxyz") for _ in range(rng.randrange(8, 24))) + base[at + 12 :]
        a, b = L.normal(base), L.normal(other)
        x, y = ({s[i : i + 8] for i in range(len(s) - 7)} for s in (a, b))
        likeness = len(x & y) / len(x | y)
        if likeness >= 0.8:
            keys = L.bands([a, b])
            met += bool((keys[0] == keys[1]).any())
            wanted += 1 - (1 - likeness**L.ROWS) ** L.BANDS
    assert wanted > 100 and met >= 0.97 * wanted


def test_near_against_sets():
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdef") for _ in range(60)) for _ in range(6)]
    lines = list({b[:i] + "zz" + b[i:] for b in base for i in rng.sample(range(60), 5)} | set(base) | {"short", "x"})
    lines = [L.normal(x) for x in lines]
    sets = [{x.ljust(8, b"\0")[i : i + 8] for i in range(max(1, len(x) - 7))} for x in lines]
    *_, first = L.near(lines)
    group = list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    assert all((first[i] == first[j]) == (group[i] == group[j]) for i in range(len(lines)) for j in range(i))
