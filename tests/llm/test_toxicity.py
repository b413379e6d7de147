import zlib

import numpy as np
import pytest

from jobweave.llm import toxicity as X
from tests.conftest import TESTDATA


def test_gradients(monkeypatch):
    monkeypatch.setattr(X.np, "float32", np.float64)
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in X.fresh().items()}
    words = X.Words()
    at, counts, _ = words.numbers(["a bad cat sat", "the dog", "worthless big dog ran home now"])
    _, start, size = X.windows(counts)
    where, inside = X.gathered(at, start, size)
    label = np.array([1, 0, 1.0])
    _, g = X.gradients(p, words, where, inside, label)
    for k, v in p.items():
        places = [tuple(rng.integers(0, d) for d in v.shape) for _ in range(3)]
        if k in ("word", "char"):
            places = [((words.place if k == "word" else words.grams)[i], 1) for i in range(3)]
        for i in places:
            old = v[i]
            losses = []
            for step in (1e-5, -1e-5):
                v[i] = old + step
                losses.append(X.gradients(p, words, where, inside, label)[0])
            v[i] = old
            numeric = (losses[0] - losses[1]) / 2e-5
            assert abs(numeric - g[k][i]) < 1e-6 + 1e-3 * abs(numeric), k


def test_log_odds_leave_out_a_texts_own_part():
    """The tables by plain counting of texts, with and without each part."""
    rng = np.random.default_rng(4)
    block = [" ".join(rng.choice(["idiot", "idiots", "stone", "stones,", "glass", "river"], rng.integers(0, 5))) for _ in range(40)]
    label, part, words = np.arange(40) % 3 == 0, np.arange(40) % X.PARTS, X.Words()
    at, counts, _ = words.numbers(block)
    got = X.odds(words, at, counts, label.astype(np.float32), part)
    for word, i in words.number.items():
        for k, n in enumerate(X.HEADS):
            head = word.strip(",")[:n]
            has = np.array([any(w.strip(",")[:n] == head for w in t.split()) for t in block])
            for table in range(X.PARTS + 1):
                use = part != table
                bad, good = (((has & use & (label == v)).sum() + 1) / ((use & (label == v)).sum() + 2) for v in (True, False))
                assert abs(got[table, k, words.heads[i, k]] - X.ODDS * np.clip(np.log(bad / good), -2, 4)) < 1e-6


def test_windows_cover_everything():
    for n in (0, 1, 63, 64, 65, 96, 97, 1000):
        _, start, size = X.windows(np.array([n]))
        assert {i for s, k in zip(start.tolist(), size.tolist(), strict=True) for i in range(s, s + k)} == set(range(n))
        assert all(b - a == X.STRIDE for a, b in zip(start, start[1:], strict=False))


def test_blocks_do_not_matter():
    """A text's score is the same alone, among others and after the worker forgot its words."""
    scorer, block = X.Scorer(X.fresh()), ["a b c " * 50, "", "one two", "z " * 200, "x"]
    together = scorer.logits(block)
    scorer.clear()
    assert np.allclose(together, [scorer.logits([t])[0] for t in block], atol=1e-5)


@pytest.fixture(scope="module")
def held(spark):
    docs, labels = (spark.read.parquet(f"{TESTDATA}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    return X.folded(docs, labels).join(labels, "doc_id").toPandas()


def test_held_out_accuracy(held):
    assert (held.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in held.doc_id]).all() and held.score.between(0, 1).all()
    own = held[held.held_out]
    assert (own.predicted == (own.score >= 0.5)).all()
    assert (own.predicted == own.toxic).mean() > 0.96
    assert own.predicted[own.toxic == 1].mean() > 0.9 and own.predicted[own.toxic == 0].mean() < 0.012


def test_edges(spark):
    rows = [(i, "you are a worthless idiot" if i % 2 else "a calm day by the river", i % 2) for i in range(40)]
    docs = spark.createDataFrame([(i, t, 0.7, "k") for i, t, _ in rows] + [(None, None, None, None), (100, "", 0.1, "k"), (1, rows[1][1], 0.7, "k")], "doc_id long, text string, score double, toxic string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows] + [(None, 1), (100, None)], "doc_id long, toxic int")
    got = X.folded(docs, labels).collect()
    assert len(got) == 43 and all(0 <= r.score <= 1 for r in got) and not next(r for r in got if r.doc_id is None).held_out
    kept = X.accepted(docs, labels)
    assert kept.columns == docs.columns and {r.score for r in kept.where("doc_id = 2").collect()} == {0.7}
    assert {r.doc_id % 2 for r in kept.where("doc_id < 40").collect()} == {0}
    assert {r.predicted for r in X.folded(docs, labels.limit(0)).collect()} == {0}
    assert {r.predicted for r in X.folded(docs, labels.where("toxic = 1")).collect()} == {1}
    assert X.folded(docs.limit(0), labels).count() == 0


def test_forward_pass_by_loops():
    """The network's logit for one window, number by number, from its definition."""
    import math

    p, words, h = X.fresh(3), X.Words(), X.HIDDEN
    text = "you are a moron, a stone under glass"
    at, counts, _ = words.numbers([text])
    vectors = words.vectors(p)
    own = [[float(v) for v in vectors[i]] for i in at.tolist()]
    sig = lambda x: 1 / (1 + math.exp(-x))

    def layer(d, xs):
        state, out = [0.0] * h, []
        for x in xs:
            a = [sum(x[i] * float(p[f"in_{d}"][i, j]) for i in range(len(x))) + float(p[f"bias_{d}"][j]) for j in range(3 * h)]
            b = [sum(state[i] * float(p[f"own_{d}"][i, j]) for i in range(h)) for j in range(3 * h)]
            z = [sig(a[j] + b[j]) for j in range(h)]
            r = [sig(a[h + j] + b[h + j]) for j in range(h)]
            m = [math.tanh(a[2 * h + j] + r[j] * b[2 * h + j]) for j in range(h)]
            state = [z[j] * state[j] + (1 - z[j]) * m[j] for j in range(h)]
            out.append(state)
        return out

    forward, backward = layer("f", own), layer("b", own[::-1])[::-1]
    both = [f + b for f, b in zip(forward, backward, strict=True)]
    asked = []
    for s in both:
        seen = [math.tanh(sum(s[i] * float(p["look"][i, j]) for i in range(2 * h)) + float(p["look_bias"][j])) for j in range(X.ATTENTION)]
        asked.append(math.exp(sum(x * float(w) for x, w in zip(seen, p["ask"], strict=True))))
    pooled = [sum(w * s[i] for w, s in zip(asked, both, strict=True)) / sum(asked) for i in range(2 * h)]
    expected = sum(x * float(w) for x, w in zip(pooled, p["out"], strict=True)) + float(p["out_bias"][0])
    assert abs(X.Scorer(p).logits([text])[0] - expected) < 1e-4
    # A long text has the logit of its most toxic window.
    long = " ".join(["stone"] * 100 + text.split() + ["glass"] * 70)
    every = [X.Scorer(p).logits([" ".join(long.split()[i : i + X.WINDOW])])[0] for i in range(0, len(long.split()) - X.STRIDE, X.STRIDE)]
    assert abs(X.Scorer(p).logits([long])[0] - max(every)) < 1e-4
