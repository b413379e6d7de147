import random

import numpy as np

import corpus_pipeline
from jobweave.llm import neardup as N


def brute(rows):
    """The least id of each component of all pairs at five-word Jaccard >= 0.8."""
    words = {d: (t or "").split() for d, t in rows}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} for d, w in words.items()}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {root(d) for d in sets}


def rows():
    """Texts with copies of some words exchanged at one place, so that likeness falls on both sides of 0.8."""
    rng = random.Random(5)
    out = ["", None, " \n", "one", "one two", "one two three four five"]
    for n in (3, 20, 40, 60, 200, 600):
        for _ in range(4):
            base = [f"w{rng.randrange(5000)}" for _ in range(n)]
            out.append(" ".join(base))
            for share in (0.01, 0.03, 0.06, 0.1, 0.12, 0.2):
                k, copy = max(1, int(n * share)), list(base)
                at = rng.randrange(n - k + 1)
                copy[at : at + k] = [f"x{rng.randrange(5000)}" for _ in range(k)]
                out.append(" ".join(copy))
    return list(enumerate(out))


def test_stage_against_brute_force(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string")
    got = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows())


def test_tiles_and_edges(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string")
    assert {r.doc_id for r in N.representatives(docs, limit=3).collect()} == brute(rows())
    assert N.representatives(docs.limit(0)).count() == 0
    twice = docs.where("doc_id = 9").unionByName(docs.where("doc_id = 9"))
    assert [tuple(r) for r in N.representatives(twice).collect()] == [rows()[9]]


def test_shingles():
    assert len(N.shingles(b"")) == 0 and len(N.shingles(b"a b")) == len(N.shingles(b"a b c d e")) == 1
    assert N.shingles(b"a b")[0] != N.shingles(b"b a")[0]
    assert len(N.shingles(b"a b c d e f a b c d e")) == 6
    assert not np.intersect1d(N.shingles(b"a b c d e"), N.shingles(b"a b c d f")).size


def test_links_of_simhash(spark):
    """Texts that operator 6 links though few of their five-word shingles are common, blank ones, and a chain of both kinds of link."""
    loop = "one two three four five six seven eight nine ten eleven " * 60
    tail = lambda c: " ".join(f"{c}{i}" for i in range(12))
    rows = [(3, loop + tail("a")), (2, loop + tail("b")), (7, loop + tail("b") + " more"), (4, " ".join(f"w{i}" for i in range(90))), (5, None), (6, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert N.joined(*map(np.array, zip(*[(i, int(x)) for i in (0, 1) for x in N.shingles(rows[i][1].encode()) >> np.uint64(1)], strict=True)), 2)[0] == []
    assert sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["simhash"](spark, docs, "").collect()) == [2, 4, 5]
