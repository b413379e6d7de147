"""Itemsets and rules against brute force."""

from itertools import combinations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from jobweave.operators import mining, skills

BASKETS = [["python", "django", "docker", "aws"], ["python", "django", "docker", "git"], ["python", "fastapi", "docker", "aws"], ["python", "flask", "docker", "aws"], ["python", "django", "docker", "aws"]]


def frame(spark, baskets):
    return spark.createDataFrame([(b,) for b in baskets], "items array<string>")


def brute(baskets, support, confidence):
    n = len(baskets)
    items = sorted({x for b in baskets for x in b})
    freq = {c: f for k in range(1, len(items) + 1) for c in combinations(items, k) if (f := sum(set(c) <= set(b) for b in baskets)) and f / n >= support}
    rules = {}
    for s, f in freq.items():
        for k in range(1, len(s)):
            for a in combinations(s, k):
                c = tuple(x for x in s if x not in a)
                if f / n / (freq[a] / n) >= confidence:
                    rules[a, c] = (f / n, f / freq[a], f * n / freq[a] / freq[c])
    return freq, rules


def check(spark, baskets, support, confidence):
    freq, rules = brute(baskets, support, confidence)
    sets = mining.itemsets(frame(spark, baskets), support)
    assert {tuple(r.items_): r.freq for r in sets.withColumnRenamed("items", "items_").collect()} == freq
    got = {(tuple(r.antecedent), tuple(r.consequent)): (r.support, r.confidence, r.lift) for r in mining.rules(sets, confidence).collect()}
    assert got.keys() == rules.keys()
    for k, v in rules.items():
        assert got[k] == pytest.approx(v)


def test_worked_case(spark):
    check(spark, BASKETS, 0.4, 0.7)
    rules = mining.mined(frame(spark, BASKETS), 0.4, 0.7)
    assert rules.count() == 22
    assert "docker" in [r.item for r in mining.implied(rules, ["python", "django"]).collect()]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=4, unique=True), min_size=1, max_size=6))
def test_random_baskets(spark, baskets):
    check(spark, baskets, 0.3, 0.5)


def test_edges(spark):
    assert mining.mined(frame(spark, []), 0.2, 0.6).count() == 0
    assert mining.itemsets(frame(spark, [[], [], [], ["a"]]), 0.5).count() == 0
    assert mining.itemsets(frame(spark, [["a", "a"], None]), 0.5).first().freq == 1
    threshold = [["a"]] * 7 + [["b"]] * 93  # 7 of 100 meets 0.07
    assert {r["items"][0] for r in mining.itemsets(frame(spark, threshold), 0.07).collect()} == {"a", "b"}


def test_order_of_top_rules(spark):
    rows = mining.top_rules(mining.mined(frame(spark, BASKETS), 0.4, 0.7), 5).collect()
    assert len(rows) == 5 and [r.confidence for r in rows] == sorted((r.confidence for r in rows), reverse=True)


def test_skill_index(spark):
    docs = spark.createDataFrame([("Python Django",), ("python docker docker",), (" \n",), ("nothing",), (None,)], "text string")
    assert {r.skill: r.doc_count for r in skills.document_frequency(docs).collect()} == {"python": 2, "django": 1, "docker": 1}
    total = skills.total_documents(docs)
    assert total.first().total_docs == 3
    counts = spark.createDataFrame([("python", 5), ("django", 1)], "skill string, doc_count long")
    ten = spark.createDataFrame([(10,)], "total_docs long")
    asked = spark.createDataFrame([("Python",), ("django",), ("rust",), ("",), (None,)], "skill string")
    assert skills.recall_proxy(asked, counts, ten, 0.05).first().recall == pytest.approx(2 / 3)
    assert skills.recall_proxy(asked.limit(0), counts, ten).first().recall == 0.0
    assert [r.skill for r in skills.top(skills.document_frequency(docs), 2).collect()] == ["python", "django"]


def test_transactions(spark):
    rows = [("IT", "", "Python, Docker", [], [], [], []), ("영업", "", "Python, Docker", [], [], [], []), ("IT", "", "Python", [], [], [], [])]
    postings = spark.createDataFrame(rows, "category string, job_title string, raw_text string, responsibilities array<string>, requirements array<string>, preferred array<string>, skills array<string>")
    assert skills.transactions(postings).count() == 2
    assert [r["items"] for r in skills.transactions(postings, it_only=True).collect()] == [["docker", "python"]]


def test_itemsets_of_twenty(spark):
    """One itemset of twenty items, with weak items in it: far from all of its splits are tried."""
    items = [f"i{k:02}" for k in range(20)]
    rows = [(items[:-2], 50, 0.5)] + [(list(c), 50, 0.5) for k in range(1, 3) for c in combinations(items[:18], k)]
    # As if only single items and pairs had a support above the whole set's.
    rows += [(list(c), 100 if len(c) == 17 else 90, 1.0 if len(c) == 17 else 0.9) for k in (16, 17) for c in combinations(items[:18], k)]
    sets = spark.createDataFrame(rows, "items array<string>, freq long, support double")
    got = mining.rules(sets.where("size(items) >= 16 or size(items) <= 2"), 0.5).collect()
    whole = [r for r in got if len(r.antecedent) + len(r.consequent) == 18]
    assert {(tuple(r.antecedent), tuple(r.consequent)) for r in whole} == {(tuple(x for x in items[:18] if x not in c), c) for k in (1, 2) for c in combinations(items[:18], k)}


def test_rules_of_one_large_itemset(spark):
    """All subsets of twelve equal items: 2**12 - 2 rules, each once."""
    baskets = [[f"i{k:02}" for k in range(12)]] * 3
    rules = mining.mined(frame(spark, baskets), 0.9, 0.9)
    whole = rules.where("size(antecedent) + size(consequent) = 12")
    assert whole.count() == whole.distinct().count() == 2**12 - 2


RULE = "antecedent array<string>, consequent array<string>"


def plain_implied(rules, targets):
    items = {}
    for key, have in targets:
        items.setdefault(key, set()).update(x for x in have or [] if x is not None)
    return {(k, x) for k, have in items.items() for a, c in rules if set(a) <= have for x in set(c) - have}


@pytest.mark.parametrize("order", (1, -1))
def test_rules_that_hash_alike(spark, order):
    """['a'] to ['b', 'c'] and ['a', 'b'] to ['c'] are different rules, in whatever order they come."""
    rules = [(["a"], ["b", "c"]), (["a", "b"], ["c"])][::order]
    targets = [(1, ["a"]), (2, ["a", "b"]), (3, ["b"])]
    got = mining.implied_each(spark.createDataFrame(rules, RULE), spark.createDataFrame(targets, "id int, items array<string>"), "id")
    assert sorted(tuple(r) for r in got.collect()) == [(1, "b"), (1, "c"), (2, "c")]


def test_implied_each_against_loops(spark):
    import random

    rng = random.Random(6)
    some = lambda most: [rng.choice("abcdefgh") for _ in range(rng.randint(0, most))]
    rules = [(some(3), some(4)) for _ in range(60)]
    targets = [(rng.choice((None, *range(30))), rng.choice((None, [], some(5), [*some(4), None]))) for _ in range(60)]
    frames = lambda: (spark.createDataFrame(rules, RULE), spark.createDataFrame(targets, "id int, items array<string>"))
    got = [tuple(r) for r in mining.implied_each(*frames(), "id").collect()]
    assert len(got) == len(set(got)) and set(got) == plain_implied(rules, targets)
    nothing = frames()
    assert mining.implied_each(nothing[0].limit(0), nothing[1], "id").count() == 0 == mining.implied_each(nothing[0], nothing[1].limit(0), "id").count()


def test_implied_each_of_top_rules(spark):
    rules = mining.top_rules(mining.mined(frame(spark, BASKETS), 0.4, 0.7), 6)
    targets = [(i, list(b[:2])) for i, b in enumerate(BASKETS)]
    got = mining.implied_each(rules, spark.createDataFrame(targets, "id int, items array<string>"), "id").collect()
    assert {tuple(r) for r in got} == plain_implied([(r.antecedent, r.consequent) for r in rules.collect()], targets)


def test_index_kept_up_to_date(spark, tmp_path):
    """Adding and re-adding batches, and dropping them, equals counting what is there."""
    import random

    from jobweave.operators import skillindex

    rng, path, batches = random.Random(1), str(tmp_path / "index"), {}
    assert skillindex.frequency(spark, path).count() == 0 == skillindex.total(spark, path).first().total_docs

    def check():
        docs = spark.createDataFrame([(i, t) for i, t in enumerate(t for b in batches.values() for t in b)], "doc_id int, text string")
        assert {r.skill: r.doc_count for r in skillindex.frequency(spark, path).collect()} == {r.skill: r.doc_count for r in skills.document_frequency(docs).collect()}
        assert skillindex.total(spark, path).first().total_docs == skills.total_documents(docs).first().total_docs

    some = lambda: [rng.choice(("python docker", "Python", "java git", " ", None, "none", "Go, Rust")) for _ in range(rng.randint(1, 6))]
    for step in range(5):
        new = {b: some() for b in rng.sample(["a", "b", "c d", "e=f/g"], 2)} | ({"x": [" ", None]} if step == 2 else {"x": some()} if step == 1 else {})
        batches |= new
        skillindex.update(spark.createDataFrame([(i, t, b) for b, texts in new.items() for i, t in enumerate(texts)], "doc_id int, text string, batch string"), path)
        check()
    skillindex.drop(spark, path, "c d")
    skillindex.drop(spark, path, "not there")
    batches.pop("c d", None)
    check()


def test_index_follows_files(spark, tmp_path):
    """A file that comes again under its name, changed, is counted as it is now."""
    from pyspark.sql import functions as F

    from jobweave.operators import skillindex

    folder, path = tmp_path / "in", str(tmp_path / "index")
    folder.mkdir()

    def run():
        docs = spark.readStream.schema("text string, v int").json(str(folder)).withColumns({"batch": F.regexp_extract("_metadata.file_name", "^[^.]+", 0), "doc_id": F.lit(0)})
        skillindex.follow(docs, path, str(tmp_path / "state")).awaitTermination(60)
        return {r.skill: r.doc_count for r in skillindex.frequency(spark, path).collect()}

    (folder / "a.1.json").write_text('{"text": "python git"}\n{"text": "python"}\n')
    (folder / "b.1.json").write_text('{"text": "java"}\n')
    assert run() == {"python": 2, "git": 1, "java": 1}
    (folder / "a.2.json").write_text('{"text": "java docker"}\n')
    assert run() == {"java": 2, "docker": 1} and run() == {"java": 2, "docker": 1}
