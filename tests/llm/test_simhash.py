import random
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from jobweave.llm import simhash as S


def plain_print(text, words=3):
    found = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), text.encode()))
    shingles = [b" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] or ([b" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << i for i in range(64) if sum(h >> i & 1 for h in hashes) * 2 > len(hashes))


def plain_components(prints, bits=3):
    parent = {p: p for p in prints.values()}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    names = list(parent)
    for i, a in enumerate(names):
        for b in names[:i]:
            if (a ^ b).bit_count() <= bits:
                parent[root(a)] = root(b)
    least = {}
    for d, p in sorted(prints.items()):
        least.setdefault(root(p), d)
    return {d: least[root(p)] for d, p in prints.items()}


def texts():
    rng = random.Random(3)
    words = ["stone", "the", "river", "and", "Éé", "Walk", "night", "of", "under", "glass"]
    out = ["", None, " \t\n", "one", "One", "two words", "a\x0bb\x1cc d e", "x " * 2000]
    for _ in range(12):
        base = rng.choices(words, k=rng.choice([3, 30, 400, 900]))
        for _ in range(rng.randrange(1, 6)):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(rng.choice([" ", "\n"]).join(copy))
    return out


def test_fingerprints():
    block = [t or "" for t in texts()]
    for words in (1, 3, 5):
        assert S.fingerprints([t.encode() for t in block], words).tolist() == [plain_print(t, words) for t in block]


def test_components_of_texts(spark):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r for r in S.grouped(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    prints = {i: plain_print(t or "") for i, t in rows}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == plain_components(prints)


def planted(bits_apart):
    """Fingerprints in loose and tight groups."""
    rng = random.Random(11)
    prints = []
    for _ in range(25):
        base = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 14)):
            other = base
            for _ in range(rng.randrange(bits_apart + 1)):
                other ^= 1 << rng.randrange(64)
            prints.append(other)
    return sorted(set(prints))


def test_links_for_all_bucket_sizes(spark):
    """Pairs, buckets in one task, and buckets that are linked through points."""
    for bits, limit in ((3, 4096), (3, 3), (2, 3), (1, 2), (5, 3)):
        prints = planted(bits)
        signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
        frame = spark.createDataFrame([(i, p) for i, p in enumerate(signed)], "doc_id long, fingerprint long")
        got = {r.doc_id: r.component_id for r in S._classes(frame, bits, limit).collect()}
        assert got == plain_components(dict(enumerate(prints)), bits), (bits, limit)


def test_representatives(spark):
    rows = [(3, "same text here now", "x"), (1, "same text here now", "y"), (1, "same text here now", "y"), (None, None, "n"), (9, "", "e"), (5, "quite another text about stones", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = S.representatives(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id or 0, r.text, r.fingerprint) for r in got.collect()), key=str) == [(0, None, "n"), (1, "same text here now", "y"), (5, "quite another text about stones", "z")]
    assert S.grouped(docs).where(F.col("doc_id").isNull()).first().component_id == 9
    assert S.grouped(docs.limit(0)).count() == 0 and S.representatives(docs.limit(0)).count() == 0


def test_dense_bucket(spark):
    """Half the bits in common and the rest dense: large buckets only."""
    rng = random.Random(21)
    prints = sorted({(rng.getrandbits(9) << 20) | (rng.getrandbits(2) << 50) for _ in range(600)})
    frame = spark.createDataFrame(list(enumerate(prints)), "doc_id long, fingerprint long")
    got = {r.doc_id: r.component_id for r in S._classes(frame, 3, 5).collect()}
    assert got == plain_components(dict(enumerate(prints)), 3)


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c d", 2, "x"), (2, "a b c d", 3, "y")], ["doc_id", "text", "a.b", "Fingerprint"])
    got = S.signatures(docs)
    assert got.columns == ["doc_id", "a.b", "fingerprint"] and {r["a.b"] for r in got.collect()} == {2, 3}
    assert [tuple(r) for r in S.representatives(docs).collect()] == [(1, "a b c d", 2, "x")]


def test_long_text_and_repeats(spark):
    text = " ".join(f"w{i * 7919 % 4099}" for i in range(300_000))
    docs = spark.createDataFrame([(4, text), (4, text), (6, "short")], "doc_id long, text string")
    got = S.grouped(docs).collect()
    assert len(got) == 3 and {r.fingerprint for r in got if r.doc_id == 4} == {f"{plain_print(text):016x}"}


def test_variants_are_dealt_out_once(spark, monkeypatch):
    """One pass over the 64 rows of a fingerprint, and buckets that go on from batch to batch."""
    plans, written = [], S.checkpoint
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(S, "checkpoint", lambda df: (plans.append(plan(df)), written(df))[1])
    prints = planted(3)
    frame = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long")
    plans.append(plan(S.links(frame)))
    assert sum(p.count("Generate explode") for p in plans) == 1

    rows = [(1, 0), (2, 0), (2, 7), (2, 6), (2, 255), (3, 8), (3, 9), (4, 0), (4, 1), (4, 3), (4, 7), (4, 15)]
    for size in (1, 2, 5, 12):
        batches = [pa.RecordBatch.from_pylist([{"key": k, "fp": f} for k, f in rows[i : i + size]]) for i in range(0, 12, size)]
        got = [(r["a"], r["b"]) for batch in S._runs(3, 4)(iter(batches)) for r in batch.to_pylist()]
        assert sorted((a, b) for a, b in got if b is not None) == [(6, 0), (7, 0), (9, 8)] and {a for a, b in got if b is None} == {0, 1, 3, 7, 15}
