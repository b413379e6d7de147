"""Claims against a small ontology."""

import json

import pytest
from pyspark.sql import functions as F

from jobweave.operators import audit, ontology, reasoning, scoring
from jobweave.operators.ontology import Tech
from jobweave.plans.pipelines import ClaimAudit, ImpliedSkills, requirements

ONTOLOGY = [
    Tech("Docker", 2013, "container", {"1.0": 2014, "20.10": 2020}),
    Tech("Kubernetes", 2014, "orchestration", {"1.0": 2015}, ("k8s",)),
    Tech("React", 2013, "frontend", {"16": 2017, "17": 2020}, ("React.js",)),
    Tech("Next.js", 2016, "frontend", {"13": 2022}, ("NextJS",)),
    Tech("라인", 2011, "messenger", {}, ("LINE",)),
    Tech("잔디", 2014, "messenger"),
    Tech("카카오톡", 2010, "messenger"),
    Tech("한글", 1989, "office", {"2014": 2014}),
    Tech("카카오페이", 2014, "payment"),
]
CASES = {
    "저는 2010년부터 Docker를 활용해 인프라를 구축했습니다.": [("Docker", 2010, 2013, "release_year")],
    "2022년 프로젝트에서 Docker와 Kubernetes를 활용했습니다.": [],
    "2015년 프로젝트에서 React 16과 Next.js 13을 적용했습니다.": [("Next.js", 2015, 2016, "release_year")],
    "In 2015 we used React 16 and Next.js 13.": [("React", 2015, 2017, "version_year"), ("Next.js", 2015, 2016, "release_year"), ("Next.js", 2015, 2022, "version_year")],
    "2010-2014 한글 문서": [("한글", 2010, 2014, "version_year")],
    "Docker 20.10.5 2015": [],
    "2010년 React 16 React 16": [("React", 2010, 2013, "release_year"), ("React", 2010, 2017, "version_year"), ("React", 2010, 2017, "version_year")],
    "2012 v1.0 Docker": [("Docker", 2012, 2013, "release_year"), ("Docker", 2012, 2014, "version_year")],
    "2009년 온라인 LINE 채팅": [("라인", 2009, 2011, "release_year")],
    "2005년 온라인 게임을 즐겼습니다": [],
    "2010년 파이프라인 구축 경험": [],
    "2005년 라이너 노트": [],
    "2010년 잔디밭에서 산책": [],
    "1900% 매출 상승을 달성했습니다": [],
    "2010년에 잔디로 협업했습니다": [("잔디", 2010, 2014, "release_year")],
    "2008년 카카오톡으로 회의했습니다": [("카카오톡", 2008, 2010, "release_year")],
    "2008년 카카오톡에서 토론했습니다": [("카카오톡", 2008, 2010, "release_year")],
    "2014년에 카카오페이로 결제": [],
    "": [],
    None: [],
}


@pytest.fixture(scope="module")
def reports(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "doc_id int, text string")
    return ClaimAudit(ONTOLOGY).run(docs).persist()


def test_cases(reports):
    got = {r.text: [(v.tech, v.claimed_year, v.actual_year, v.kind) for v in r.violations] for r in reports.collect()}
    assert got == CASES


def test_scores(reports):
    for r in reports.collect():
        n = len(CASES[r.text])
        assert (r.n_violations, r.trust_score, r.trust_bucket) == (n, 100 - min(60, 15 * n), {0: "100", 1: "85-99", 2: "70-84"}.get(n, "<70"))
        assert r.suspect_spans == ([r.text] if n else [])


def test_summary(reports):
    got = {(r.facet, r.value): r.n for r in audit.summary(reports).collect()}
    assert got["documents", "all"] == len(CASES) and got["documents", "with violations"] == sum(bool(v) for v in CASES.values())
    assert got["kind", "version_year"] == 6 and got["tech", "Next.js"] == 3
    assert audit.summary(reports.limit(0)).count() == 0


def test_message(reports):
    v = next(r for r in reports.collect() if r.text and r.text.startswith("저는")).violations[0]
    assert v.message == "Docker는 2013년에 공개되었으나 문장은 2010년을 주장합니다."


def tech_table(spark, entries):
    rows = [(t.name, t.released_year, t.category, t.versions, list(t.aliases), i) for i, t in enumerate(entries)]
    return spark.createDataFrame(rows, "name string, released_year int, category string, versions map<string,int>, aliases array<string>, position int")


def test_table_of_technologies(spark):
    """The index finds what the expressions find: odd names, cases, particles, aliases shared or repeated."""
    odd = [
        Tech("C", 2020), Tech("C++", 2021, "", {"3": 2025}), Tech("++", 2022), Tech("+", 2022), Tech("Objective C", 2023, "", {}, ("ObjC", "objc", "C")), Tech("C언어", 2020), Tech("카프카2", 2020), Tech("스프링 부트", 2021), Tech("도", 2020), Tech("日本", 2022),
        Tech("Straße", 2020), Tech("kiosk", 2024), Tech("line", 2024), Tech("Docker", 2029, "", {}, ("dock",)), Tech("a\\E.b", 2020), Tech("Σας", 2021), Tech("", 2020, "", {}, ("alias only",)), Tech("no match", 2020),
    ]
    texts = [
        *CASES, "2010 we used C, c++ 3 and objective c.", "2011 ++ + a++b", "2012년 C언어를 카프카2345 카프카2도 스프링 부트에서 스프링부트", "2012년 도 도를 도서", "2013 日本 日本語", "2014 STRASSE strasse Straße ßC", "2015 KIOSK \u212aIO\u017f\u212a LİNE lıne",
        "2016 a\\E.b A\\e.B\nno year: docker\n2017 docker dock", "2018 ΣΑΣ σας σασ", "2019 alias only ALIAS ONLY", "2020년에 Docker 3.1 2011. 2009 docker!", "1990 1.1 docker v1 v1",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    entries = [*ONTOLOGY, *odd]
    rows = lambda found: sorted(tuple(r) for r in found.collect())
    expected = rows(audit.violations(docs, entries))
    assert len(expected) > 35 and rows(audit.violations(docs, tech_table(spark, entries))) == expected
    reports = [ClaimAudit(o).run(docs).orderBy("doc_id").collect() for o in (entries, tech_table(spark, entries))]
    assert reports[0] == reports[1]
    assert rows(audit.violations(docs, tech_table(spark, []))) == [] == rows(audit.violations(docs.limit(0), tech_table(spark, entries)))


def test_hundred_thousand_technologies(spark):
    """Plan and patterns don't grow with the table; the list is refused."""
    size = 100_000
    table = spark.range(size).select(
        F.concat(F.lit("Tool "), F.col("id").cast("string")).alias("name"), (F.lit(2000) + F.col("id") % 20).cast("int").alias("released_year"), F.lit("").alias("category"),
        F.create_map(F.lit("2"), F.lit(2021)).alias("versions"), F.array(F.concat(F.col("id").cast("string"), F.lit("번별명"))).alias("aliases"), F.col("id").cast("int").alias("position"),
    )
    said = [(i, f"In 2001 we used tool {10007 + i * 797} and Tool {10012 + i * 797} v2. 1999년에 {30000 + i * 31}번별명을 썼다.") for i in range(100)]
    got = {(r.doc_id, r.tech, r.kind) for r in audit.violations(spark.createDataFrame(said, "doc_id int, text string"), table).collect()}
    expected = set()
    for i, _ in said:
        for k in (10007 + i * 797, 10012 + i * 797):
            expected |= {(i, f"Tool {k}", "release_year")} if 2000 + k % 20 > 2001 else set()
            expected |= {(i, f"Tool {k}", "version_year")}
        expected.add((i, f"Tool {30000 + i * 31}", "release_year"))
    assert got == expected
    with pytest.raises(ValueError, match="more than"):
        ontology.entries(table)


def test_names_do_not_pass_through_the_driver(spark, tmp_path):
    """Names from a small file take many times its size, so no join sends them out; what goes out of a large index is its bits."""
    from jobweave.functions import keys

    spark.range(30_000).coalesce(1).write.parquet(f"{tmp_path}/ids")
    aliases = F.array(F.concat(F.col("id").cast("string"), F.lit("번 도구")))
    table = spark.read.parquet(f"{tmp_path}/ids").select(F.format_string("Tool %05d", "id").alias("name"), F.lit(2005).alias("released_year"), F.lit("").alias("category"), F.create_map(F.lit("2"), F.lit(2003)).alias("versions"), aliases.alias("aliases"), F.col("id").cast("int").alias("position"))
    assert "Broadcast" not in keys.index(table.select("name"))._jdf.queryExecution().sparkPlan().toString()
    docs = spark.createDataFrame([(0, "In 2001 we sold Tool 00012."), (1, "2004년 29999번 도구를 v2."), (2, "In 2001 we sold Tool 30000.")], "doc_id int, text string")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "8m")
    try:
        found = audit.violations(docs, table).select("doc_id", "tech", "kind").collect()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert sorted(map(tuple, found)) == [(0, "Tool 00012", "release_year"), (1, "Tool 29999", "release_year")]


def test_a_key_of_all_names_is_dealt_out(spark):
    """No task of the index's join reads all names for a word that all of them have."""
    from jobweave.functions import keys

    names = spark.range(4_000).select(F.concat(F.lit("tool "), F.col("id").cast("string")).alias("name"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        index = keys.index(names)
        assert {(r.name, r.key) for r in index.collect()} == {(f"tool {i}", str(i)) for i in range(4_000)}
        plan = index._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    # Both sides are dealt by key and part.
    assert sum("hashpartitioning(key#" in x and "part#" in x for x in plan.splitlines()) >= 2


def test_no_ontology(spark):
    assert audit.violations(spark.createDataFrame([(1, "2010년 Docker")], "doc_id int, text string"), []).count() == 0


def test_scorer(spark):
    docs = spark.createDataFrame([(1, "long sentence one. long sentence two."), (2, "short"), (3, None), (4, "nothing to score")], "doc_id int, text string")
    factory = lambda: lambda batch: [float("nan") if "nothing" in s else float(len(s)) + ("two" in s) * 4 for s in batch]
    got = {r.doc_id: r for r in scoring.detected(docs, factory).collect()}
    assert (got[1].perplexity, round(got[1].burstiness, 6)) == (19.0, 2.828427)
    assert got[2].ai_probability == got[3].ai_probability == got[4].ai_probability == 0.0 and got[4].perplexity != got[4].perplexity
    report = ClaimAudit(ONTOLOGY, factory).run(docs).where("doc_id = 1").first()
    assert report.trust_score == 100 - round(30 * got[1].ai_probability)


def test_ontology_file(spark, tmp_path):
    path = str(tmp_path / "o.json")
    entries = [
        {"name": "Docker", "released_year": 2013, "category": "c", "versions": {"20.10": 2020}, "aliases": ["dock"]},
        {"name": "docker", "released_year": 1800, "category": "", "versions": {"1": "x"}, "aliases": ["", "dock"]},
        "text",
        {"name": "A"},
        {"name": " ", "released_year": 2000, "category": "c", "versions": {}, "aliases": []},
        {"name": "B", "released_year": "2000", "category": "c", "versions": [], "aliases": "b"},
    ]
    (tmp_path / "o.json").write_text(json.dumps(entries))
    got = sorted(r.message for r in ontology.problems(spark, path, 2024).collect())
    assert got == sorted([
        "docker: bad released_year", "docker 1: bad version year", "docker: empty category", "docker: bad alias", "alias dock claimed by Docker, docker", "#2: not an object",
        "#3: missing aliases, category, released_year, versions", "#4: empty name", "B: bad released_year", "B: versions must be an object", "B: aliases must be a list", "duplicate name docker x2",
    ])
    (tmp_path / "o.json").write_text(json.dumps(entries[:1]))
    assert ontology.problems(spark, path, 2024).count() == 0
    known = ontology.read(spark, path)
    assert ontology.load(spark, path) == [Tech("Docker", 2013, "c", {"20.10": 2020}, ("dock",))]
    asked = spark.createDataFrame([("DOCK",), ("x",)], "asked string")
    assert {r.asked: r.name for r in ontology.lookup(asked, known).collect()} == {"DOCK": "Docker", "x": None}
    assert ontology.read(spark, str(tmp_path / "none.json")).count() == 0


def test_implied_pipeline(spark):
    corpus = spark.createDataFrame([(t,) for t in ("Python Django Docker PostgreSQL", "Python Django Docker Redis", "Python Django Git", "Java Spring")], "text string")

    class Client:
        def complete(self, prompt):
            return f'so {len(prompt)}\nIMPLICIT: ["kubernetes", "docker"]'

    row = ImpliedSkills(client=Client).run(spark, "Python과 Django 3년 이상", corpus).first()
    assert row.explicit == ["django", "python"] and "docker" in row.implicit_arm and row.implicit_llm == ["kubernetes", "docker"]
    assert row.implicit_union == sorted(set(row.implicit_arm) | {"kubernetes", "docker"})
    bare = ImpliedSkills().run(spark, "Python").first()
    assert (bare.implicit_arm, bare.implicit_llm, bare.implicit_union) == ([], [], [])


def test_implied_skills_of_many_postings(spark):
    corpus = spark.createDataFrame([(t,) for t in ("Python Django Docker PostgreSQL", "Python Django Docker Redis", "Python Django Git", "Java Spring")], "text string")
    texts = ["Python과 Django 3년 이상", "Java 5년 이상, Spring", "nothing", None, "docker"]
    targets = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "doc_id int, text string, more string")

    class Client:
        def complete(self, prompt):
            return 'IMPLICIT: ["kubernetes"]' if "django" in prompt else "no"

    skills = ImpliedSkills(client=Client)
    rules = skills.rules(corpus)
    got = {r.doc_id: r for r in skills.run_all(targets, rules).collect()}
    assert len(got) == len(texts) and got[0].more == "kept"
    assert (got[0].experience_years, got[1].experience_years, got[0].implicit_llm) == ([3], [5], ["kubernetes"])
    for i, text in enumerate(texts):
        one = ImpliedSkills(client=Client).run(spark, text, corpus).first()
        assert (got[i].tech_stack, got[i].implicit_arm, got[i].implicit_union) == (one.explicit, one.implicit_arm, one.implicit_union)
    assert [r.implicit_arm for r in ImpliedSkills().run_all(targets).collect()] == [[]] * 5


def test_words_from_a_table(spark):
    """The pipeline and baskets give the same by a table of words as by a list."""
    from jobweave.functions.vocabulary import TECH_KEYWORDS
    from jobweave.operators import skills as S

    words = spark.createDataFrame([(w,) for w in TECH_KEYWORDS], "word string")
    texts = ["Python Django Docker 3년", "Python Django Docker Redis", "python django git", "Java Spring boot", None, "Python Django Docker 3년"]
    docs = spark.createDataFrame([(i % 4, t, ["K8S", "React.js"]) for i, t in enumerate(texts)], "doc_id int, text string, skills array<string>")
    got = []
    for w in (TECH_KEYWORDS, words):
        skills = ImpliedSkills(w, 0.3, 0.5)
        rows = skills.run_all(docs, skills.rules(docs)).select("doc_id", "text", "tech_stack", "experience_years", "implicit_union").collect()
        postings = docs.select(F.col("text").alias("raw_text"), *(F.lit(None).cast("array<string>").alias(c) for c in ("responsibilities", "requirements", "preferred")), "skills")
        got.append((sorted(map(str, rows)), sorted(map(str, S.transactions(postings, 3, words=w, align=True).collect()))))
    assert got[0] == got[1] and len(got[0][0]) == 6 and len(got[0][1]) == 5


def test_own_extractor_and_auditor(spark):
    docs = spark.createDataFrame([(1, "x y"), (2, "x")], "doc_id int, text string")
    split = lambda rows, text: rows.withColumn("tech_stack", F.split(text, " "))
    rules = spark.createDataFrame([(["x"], ["y", "z"])], "antecedent array<string>, consequent array<string>")
    assert [r.implicit_union for r in ImpliedSkills(extractor=split).run_all(docs, rules).orderBy("doc_id").collect()] == [["z"], ["y", "z"]]
    mine = lambda rows, text, probability: rows.withColumn("trust_score", F.length(text) + F.coalesce(F.col(probability) if probability else F.lit(0), F.lit(0)))
    assert [r.trust_score for r in ClaimAudit(auditor=mine).run(docs).orderBy("doc_id").collect()] == [3, 1]


def test_requirements(spark):
    docs = spark.createDataFrame([("Python 3년 이상, 정보처리기사",)], "text string")
    ner = lambda: lambda texts: [[{"entity_group": "CVL", "word": "정보처리기사", "score": 0.9, "start": 0, "end": 6}, {"entity_group": "PER", "word": "x", "score": 0.9, "start": 0, "end": 1}, {"entity_group": "QT", "word": " ", "score": 0.9, "start": 0, "end": 1}] for _ in texts]
    row = requirements(docs, ner=ner).first()
    assert (row.tech_stack, row.experience_years, row.qualifications) == (["python"], [3], ["정보처리기사"])
    assert requirements(docs).first().qualifications == []


def test_prompts_are_asked_once(spark):
    rows = spark.createDataFrame([("a", ["x"])] * 5, "text string, skills array<string>")

    class Client:
        def complete(self, prompt):
            return 'IMPLICIT: ["y"]'

    assert [r.implicit_llm for r in reasoning.implied(rows, Client).collect()] == [["y"]] * 5
    assert reasoning.completed(rows.select(F.lit("p").alias("prompt")), Client).count() == 1


class Counted:
    """A client that writes down what it is asked, and fails at one prompt until a flag is there."""

    def __init__(self, folder):
        self.folder = folder

    def complete(self, prompt):
        import os

        with open(f"{self.folder}/asked", "a") as f:
            f.write(f"{prompt[-1].strip() or 'p'}\n")
        if prompt.endswith("f") and not os.path.exists(f"{self.folder}/flag"):
            raise OSError("no answer")
        return None if prompt.endswith("n") else f"to {prompt}"


def test_answers_are_kept(spark, tmp_path):
    store, asked = str(tmp_path / "store"), lambda: sorted((tmp_path / "asked").read_text().split())
    run = lambda letters, **more: {r.prompt: r.answer for r in reasoning.completed(spark.createDataFrame([(x,) for x in letters], "prompt string"), lambda: Counted(str(tmp_path)), store, **more).collect()}
    assert run([*"abbn", None]) == {"a": "to a", "b": "to b", "n": None} and asked() == ["a", "b", "n"]
    assert run("abn") == {"a": "to a", "b": "to b", "n": None} and asked() == ["a", "b", "n"]
    assert run("bc") == {"b": "to b", "c": "to c"} and asked() == ["a", "b", "c", "n"]
    # A broken run keeps the chunks before it.
    with pytest.raises(Exception, match="no answer"):
        run("abcdefghi", chunks=7)
    before = asked()
    (tmp_path / "flag").touch()
    assert run("abcdefghi", chunks=7) == {x: f"to {x}" for x in "abcdefghi"}
    assert set(before) & set("deghi") and all(asked().count(x) <= 2 for x in "defghi") and asked().count("a") == 1
    done = asked()
    assert run("abcdefghi") == {x: f"to {x}" for x in "abcdefghi"} and asked() == done
    skills = ImpliedSkills(client=lambda: Counted(str(tmp_path)), answers=str(tmp_path / "more"))
    targets = spark.createDataFrame([(1, "python"), (2, "java")], "doc_id int, text string")
    for _ in range(2):
        assert skills.run_all(targets).count() == 2
    assert len(asked()) == len(done) + 2
