import zlib

import numpy as np
from pyspark.sql import functions as F

from jobweave.llm import langid as G
from tests.conftest import TESTDATA


def learned(rows):
    """Whole models by language: of all rows, and of those not held back."""
    rows = rows if "back" in rows.columns else rows.withColumn("back", F.lit(False))
    counted = G.gram_counts(rows).cache()
    names, *both = G.sides(counted)
    found, out = counted.toPandas(), ({}, {})
    for into, side, c in zip(out, both, ("n", "fit"), strict=True):
        for lang, known in zip(names, side, strict=True):
            own = found[(found.lang == lang) & (found[c] > 0)]
            if known:
                into[lang] = G.Piece(own.gram.to_numpy(np.int64).view(np.uint64), own[c].to_numpy(np.int64), *known)
    return out


def test_probabilities_sum_to_one(spark):
    rows = spark.createDataFrame([("en", "the cat sat on the mat the end"), ("de", "der hund und die katze")], "lang string, text string")
    models, _ = learned(rows)
    assert list(models) == ["de", "en"]
    packed, _ = G.grams(["the", "cat", "zzz"])
    for context in set((packed >> np.uint64(16)).tolist()):
        every = np.array([(context << 16 | c) & (2**64 - 1) for c in range(65536)], np.uint64)
        assert abs((2.0 ** -models["en"].bits(every)).sum() - 1) < 1e-6


def test_against_direct_formula(spark):
    """Interpolated Kneser-Ney by dictionaries, for the n-grams of a small text."""
    words = "the cat sat on the mat and the rat ran".split()
    model = learned(spark.createDataFrame([("en", " ".join(words))], "lang string, text string"))[0]["en"]
    packed, _ = G.grams(words)
    counts = [{}, {}, {}, {}]
    for g in packed.tolist():
        counts[3][g] = counts[3].get(g, 0) + 1
    for n in (2, 1, 0):
        for g in counts[n + 1]:
            low = g & ((1 << 16 * (n + 1)) - 1)
            counts[n][low] = counts[n].get(low, 0) + 1

    def p(n, g):
        if n < 0:
            return 1 / 65536
        own = g & ((1 << 16 * (n + 1)) - 1)
        same = {k: v for k, v in counts[n].items() if k >> 16 == own >> 16}
        if not same:
            return p(n - 1, g)
        ones, twos = (sum(v == k for v in counts[n].values()) for k in (1, 2))
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        return max(same.get(own, 0) - d, 0) / sum(same.values()) + d * len(same) / sum(same.values()) * p(n - 1, g)

    for g in [*packed.tolist(), *G.grams(["xylo", "that"])[0].tolist()]:
        assert abs(-np.log2(p(3, g)) - model.bits(np.array([g], np.uint64))[0]) < 1e-9


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet")
    got = G.folded(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    assert (got.lang_pred == got.lang)[got.held_out].mean() > 0.98
    assert got.score.between(0, 1).all() and got.rejected.mean() < 0.05


def test_edges(spark):
    rows = [(1, "the cat sat", "en"), (3, "der hund", "de"), (None, "the mat", "en"), (5, None, "en"), (6, "", "de"), (7, "123 !!", None), (8, "the", None)] * 2
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, lang string, score string")
    got = G.folded(docs).collect()
    assert len(got) == 14 and all((r.lang_pred == "und") == (r.doc_id in (5, 6, 7)) for r in got) and all(r.score == 0 for r in got if r.lang_pred == "und")
    assert {r.lang_pred for r in got if r.doc_id == 8} == {"en"}
    none = G.folded(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"} and G.folded(docs.limit(0)).count() == 0


def test_all_grams_count(spark):
    """A small language keeps its n-grams beside a language of over four million."""
    rng = np.random.default_rng(1)
    large = [("zh", "".join(map(chr, rng.integers(0x4E00, 0x9FA0, 21_000)))) for _ in range(200)]
    models, _ = learned(spark.createDataFrame([*large, ("en", "the cat sat")], "lang string, text string"))
    assert list(models) == ["en", "zh"]
    assert len(models["zh"].levels[-1][0]) > 4_000_000 and len(models["en"].levels[-1][0]) == 12


def test_signs_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "the cat sat", "en"), (2, "½ ² ①", None), (3, "Ⅷ 12_", None), (4, "½ é", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in G.folded(docs).orderBy("doc_id").collect()] == ["en", "und", "und", "en"]


def test_decision_and_score_by_hand(spark):
    """Each word's bits under each language, summed with plain loops; the score from its definition."""
    teach = [(i, t, lang) for i, (t, lang) in enumerate([("the cat sat on the mat and the rat", "en"), ("der hund und die katze auf der matte", "de"), ("le chat et le chien sur la table", "fr")] * 6)]
    asked = [(100 + i, t, None) for i, t in enumerate(["the hund", "la matte", "x", "Der Chat", "rat rat rat katze", "the the the the the the the the the the the the the the"])]
    docs = spark.createDataFrame(teach + asked, "doc_id long, text string, lang string")
    learn = [(t, lang) for i, t, lang in teach if zlib.crc32(str(i).encode()) % 3 != 1]
    models, _ = learned(spark.createDataFrame(learn, "text string, lang string"))
    got = {r.doc_id: r for r in G.folded(docs).collect()}
    for i, text, _ in asked:
        bits, n = dict.fromkeys(models, 0.0), 0
        for word in text.lower().split():
            packed, _ = G.grams([word])
            n += len(packed)
            for lang, model in models.items():
                bits[lang] += sum(model.bits(np.array([g], np.uint64))[0] for g in packed.tolist())
        entropy = {lang: b / n for lang, b in bits.items()}
        best = min(entropy, key=lambda x: (entropy[x], x))
        score = 1 / sum(2.0 ** (-(e - entropy[best]) * min(n, G.EVIDENCE)) for e in entropy.values())
        assert got[i].lang_pred == best and abs(got[i].score - score) < 1e-9 and abs(got[i].cross_entropy - entropy[best]) < 1e-9


def test_calibration_on_rows_held_back(spark):
    """Mean and deviation come from rows that the models beside them don't know."""
    rng = np.random.default_rng(3)
    say = lambda: " ".join("".join(rng.choice(list("abcdefg"), rng.integers(2, 7))) for _ in range(12))
    rows = [(i, say(), "xx") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("back", F.pmod(F.xxhash64("doc_id", "text"), F.lit(G.FOLDS)) == 0)
    back = {r.doc_id for r in docs.where("back").collect()}
    assert 15 < len(back) < 70
    _, fit = learned(docs)
    direct, _ = learned(docs.where("not back"))
    assert (fit["xx"].levels[-1][0] == direct["xx"].levels[-1][0]).all() and (fit["xx"].levels[-1][1] == direct["xx"].levels[-1][1]).all()
    entropies = [direct["xx"].bits(G.grams(t.split())[0]).mean() for i, t, _ in rows if i in back]
    names, numbers = G.measured(docs, F.lit(True), F.lit(False))
    mean, deviation = G.calibrated(numbers, names)["xx"]
    assert abs(mean - np.mean(entropies)) < 1e-9 and abs(deviation - np.std(entropies)) < 1e-6


def test_long_text(spark):
    docs = spark.createDataFrame([*((i, "the cat sat", "en") for i in range(6)), *((i, "der hund", "de") for i in range(10, 16)), (7, "der hund und " * 200_000, None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in G.folded(docs).where("doc_id = 7").collect()} == {"de"}


def test_grams_beyond_the_common_ones(spark, monkeypatch):
    """Rows are the same whether all n-grams go to the workers, some, or none; n-grams in pieces give a whole model's bits."""
    docs = spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet").unionByName(spark.createDataFrame([(-1, "x" * 300 + " the " + "y" * 100, None, "k", 0)], "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
    every = {r.doc_id: r for r in G.folded(docs).collect()}
    for head in (0, 20_000):
        monkeypatch.setattr(G, "HEAD", head)
        got = G.folded(docs).collect()
        assert len(got) == len(every)
        for r in got:
            e = every[r.doc_id]
            assert (r.lang_pred, r.rejected, r.held_out) == (e.lang_pred, e.rejected, e.held_out) and abs(r.score - e.score) < 1e-9 and abs(r.cross_entropy - e.cross_entropy) < 1e-9
    rows = docs.where("lang is not null and text is not null").withColumn("back", F.lit(False))
    models, _ = learned(rows)
    counted = G.gram_counts(rows)
    asked, _ = G.grams(["there", "zzz", "où", "ändern", "q"])
    wanted = spark.createDataFrame([(int(g), 1) for g in np.unique(asked).view(np.int64)], "gram long, n long")
    for r in G.gram_bits(counted, wanted, *G.sides(counted)).collect():
        whole = [m.bits(np.array([r.gram], np.int64).view(np.uint64))[0] for m in models.values()]
        assert np.allclose(r.bits, whole * 2, atol=1e-9)
