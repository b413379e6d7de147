"""Text expressions against worked cases."""

import json

from pyspark.sql import functions as F

from jobweave.functions import text as T

KEYWORDS = {
    "Python을 사용해 개발했습니다.": ["python"],
    "I am going to ago": [],
    "javafication": [],
    "restoration project": [],
    "Spring Boot 와 Node.js 를 함께 사용했습니다.": ["node.js", "spring boot"],
    "TypeScript 와 JavaScript 모두 사용": ["javascript", "typescript"],
    "(REST) API, gRPC, CI/CD": ["ci/cd", "grpc", "rest"],
    "Spring Boot 환경": ["spring boot"],
    "a Spring and Spring Boot": ["spring", "spring boot"],
    "": [],
    None: [],
}


def test_keywords(evaluate):
    assert evaluate(T.find_keywords, list(KEYWORDS)) == list(KEYWORDS.values())
    assert evaluate(lambda t: T.find_keywords(t, []), ["python"]) == [[]]


def test_experience_and_years(evaluate):
    texts = ["3년 이상 5 년 ７년", "Python과 Django, AWS 경험 3년 이상 요구됩니다.", "2015년", "99999999999년", None]
    assert evaluate(T.experience_years, texts) == [[3, 5, 7], [3], [2015], [], []]
    texts = ["2010년 and 2015.", "1900% 매출", "2000건의", "12010 2010", "2010-2014", "1979 2030", "(1999)"]
    assert evaluate(T.claim_years, texts) == [[2010, 2015], [], [], [2010], [2010, 2014], [], [1999]]


def test_versions(evaluate):
    assert evaluate(T.version_tokens, ["React 16과 v1.2.3 20.10.5 x9 3"]) == [["1.2.3", "20.10.5", "3"]]


def test_sentences_and_lines(evaluate):
    assert evaluate(T.audit_sentences, ["A b. C d! E\n\n F。 G", " \n ", None]) == [["A b.", "C d!", "E", "F。", "G"], [], []]
    assert evaluate(T.detector_sentences, ["Next.js is good. ok", None]) == [["js is good"], []]
    assert evaluate(T.clean_lines, ["- a\r\n• b ·\x0b* c\n\n\t", None]) == [["a", "b", "c"], []]


def test_strip_is_unicode(evaluate):
    assert evaluate(T.strip, ["　\t a \x1f\n", "", None]) == ["a", "", None]


def test_skill_aliases(evaluate):
    cases = {"Spring Framework": "spring", "React.js": "react", "ReactJS": "react", "Node": "node.js", "nodejs": "node.js", " k8s ": "kubernetes", "Photoshop": "photoshop", "": "", "   ": "", None: ""}
    assert evaluate(T.normalize_skill, list(cases)) == list(cases.values())


def test_categories(evaluate):
    cases = {
        "사무": "사무/행정", "사무직": "사무/행정", "일반행정": "사무/행정", "마케팅": "마케팅", "콘텐츠마케팅": "마케팅", "브랜드마케팅": "마케팅", "콘텐츠마케팅기획": "마케팅",
        "백엔드개발자": "IT/개발", "프론트엔드 엔지니어": "IT/개발", "데이터분석": "IT/개발", "전략기획": "기획", "서비스기획": "기획", "해외영업": "영업", "": "미분류", None: "미분류", "점성술사": "기타", " ": "기타", "IT": "IT/개발", "item": "기타", "r&d": "R&D",
    }
    assert evaluate(T.normalize_category, list(cases)) == list(cases.values())


def test_implied_answers(evaluate):
    texts = ['thinking\nIMPLICIT: ["a", " b ", "", null]', "none", "IMPLICIT: [bad", 'IMPLICIT:\n["x",\n"y"]', "IMPLICIT: [oops]", None]
    assert evaluate(T.parse_implied, texts) == [["a", "b"], [], [], ["x", "y"], [], []]


def test_prompt(evaluate):
    (some, none) = evaluate(lambda t: T.implied_prompt(t, F.when(t == "x", F.array(F.lit("a"), F.lit("b"))).otherwise(F.array())), ["x", " y "])
    assert "\nx\n" in some and "\na, b\n" in some and "\ny\n" in none and "(없음)" in none


def test_probability_and_score(spark):
    rows = spark.createDataFrame([(30.0, 5.0, 0, 0.0), (100.0, 50.0, 2, 0.0), (0.0, 0.0, 9, 1.0), (60.0, 15.0, 1, 0.15)], "p double, b double, n int, q double")
    got = rows.select(T.ai_probability(F.col("p"), F.col("b")), T.trust_score(F.col("n"), F.col("q")), T.trust_bucket(T.trust_score(F.col("n")))).collect()
    assert [tuple(r) for r in got] == [(0.567, 100, "100"), (0.0, 70, "70-84"), (1.0, 10, "<70"), (0.0, 81, "85-99")]  # 30 * 0.15 = 4.5 rounds to even


def test_posting_skills(spark):
    row = spark.createDataFrame([("k8s and Python", ["K8S", "", None, "Node"])], "t string, s array<string>")
    assert row.select(T.posting_skills(F.col("t"), F.col("s"))).first()[0] == ["k8s", "kubernetes", "node.js", "python"]
    assert row.select(T.posting_skills(F.col("t"), F.col("s"), align=True)).first()[0] == ["kubernetes", "node.js", "python"]


def test_names_are_json_safe(evaluate):
    assert json.loads(evaluate(lambda t: F.to_json(T.find_keywords(t)), ["c# Java"])[0]) == ["java"]


def test_keywords_of_a_table(spark):
    """The index finds what the alternation finds, overlaps, odd characters and cases included."""
    from jobweave.functions.vocabulary import TECH_KEYWORDS
    from jobweave.operators import skills

    words = [*TECH_KEYWORDS, "c++", "c#", ".net", "++", "+", "파이썬", "파", "日本", "a b", "a b c", "b c d", "node", "js", "x\\Ey", "Straße", "σας", "kiosk", "", None, "PYTHON"]
    texts = [*KEYWORDS, "C++ c# .NET asp.net a++b +", "파이썬을 파이 x파y 日本語", "a b c d; A B; b c d", "node.js js node", "x\\Ey X\\eY", "STRASSE straße ßc++", "ΣΑΣ σας", "\u212aiosk KIO\u017fK", "c" * 50_000 + " rust", "react/vue,react"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("skills", F.lit(0)).drop("skills")
    got = {r.doc_id: r.skills for r in skills.with_keywords(docs, spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    expected = {r.doc_id: r.s for r in docs.select("doc_id", T.find_keywords(F.col("text"), [w for w in words if w]).alias("s")).collect()}
    assert got == expected
    assert skills.with_keywords(docs, spark.createDataFrame([], "word string")).where("size(skills) > 0").count() == 0


def test_hundred_thousand_keywords(spark):
    from jobweave.operators import skills

    words = spark.range(100_000).select(F.concat(F.lit("Skill "), F.col("id").cast("string")).alias("word"))
    docs = spark.createDataFrame([(i, f"skill {i * 331} and SKILL  {i}, skill {i * 7}x") for i in range(200)], "doc_id int, text string")
    got = {r.skill: r.doc_count for r in skills.document_frequency(docs, words).collect()}
    assert got == {f"skill {i * 331}": 1 for i in range(200)}


def test_categories_of_a_table(spark):
    """As the chain of conditions decides, for the built-in rules and for many others."""
    from jobweave.functions.vocabulary import JOB_CATEGORIES, OTHER
    from jobweave.operators import categories

    texts = ["", None, "Backend 개발", "데이터 분석 PM", "hr,인사", "nothing here", "QA엔지니어", "R&D 연구", "A/S 기사", "é ui/ux", "it", "bit", *(w for _, words in JOB_CATEGORIES for w in words), *(f"x{w}y" for _, words in JOB_CATEGORIES for w in words)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, category string")

    def of(rules):
        frame = spark.createDataFrame([(i, c, list(w)) for i, (c, w) in enumerate(rules)], "position int, category string, patterns array<string>")
        return {r.i: r.normalized for r in categories.categorized(rows, categories.table(frame)).collect()}

    assert of(JOB_CATEGORIES) == {r.i: r.v for r in rows.select("i", T.normalize_category(F.col("category")).alias("v")).collect()}
    many = [(f"c{i}", [f"job {i}", f"직무{i}번"]) for i in range(9_000)]
    texts[:] = [f"Job {i} 직무{i - 3}번 job {i + 5}" for i in range(10, 400, 13)] + ["job x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, category string")
    assert list(of(many).values()).count(OTHER) == 1 and sorted(of(many).values()) == sorted([*(f"c{i - 3}" for i in range(10, 400, 13)), OTHER])
    assert set(of([]).values()) == {OTHER}


def test_rules_do_not_pass_through_the_driver(spark, tmp_path):
    """Rules from a small file take many times its size, so no join sends them out."""
    from jobweave.functions.vocabulary import OTHER, UNCATEGORIZED
    from jobweave.operators import categories

    spark.range(60_000).coalesce(1).write.parquet(f"{tmp_path}/ids")
    rules = spark.read.parquet(f"{tmp_path}/ids").select(F.col("id").alias("position"), F.format_string("a category of its own, %05d", "id").alias("category"), F.format_string("a job of its own, %05d", "id").alias("pattern"))
    rows = spark.createDataFrame([(0, "A job of its own, 00012!"), (1, "a job of its own, 60000"), (2, "")], "i int, category string")
    # Not the size that is known once rows are shuffled counts here, but what Spark takes a table for before.
    limits = {"spark.sql.maxBroadcastTableSize": "8m", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    for name, value in limits.items():
        spark.conf.set(name, value)
    try:
        found = categories.categorized(rows, rules).orderBy("i").collect()
    finally:
        for name in limits:
            spark.conf.unset(name)
    assert [r.normalized for r in found] == ["a category of its own, 00012", OTHER, UNCATEGORIZED]


def test_only_tokens_that_may_be_met_are_shuffled(spark, monkeypatch):
    """Tokens of a small index meet it where they are, by a large one only those that share a bit with its keys go on; results agree."""
    from jobweave.functions import keys
    from jobweave.operators import audit, skills
    from jobweave.operators.ontology import Tech

    docs = spark.createDataFrame([(i, f"In 2001 we sold Tool {i % 7} and b-c v2.") for i in range(60)] + [(60, "in 2002 TOOL 3, Öl x")], "doc_id int, text string")
    words = spark.createDataFrame([("tool",), ("we",), ("sold tool",), ("b-c",), ("öl",), ("x",)], "word string")
    single = words.where("word in ('tool', 'we', 'x')")
    techs = spark.range(5).select(F.format_string("Tool %d", "id").alias("name"), F.lit(2005).alias("released_year"), F.lit("").alias("category"), F.expr("map('2', 2003)").alias("versions"), F.expr("array(concat('tool ', id))").alias("aliases"), F.col("id").cast("int").alias("position"))
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    found = []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for sent in (50_000, 0):
            monkeypatch.setattr(keys, "SENT", sent)
            frames = [audit.violations(docs, techs).drop("snippet"), skills.with_keywords(docs, words), skills.with_keywords(docs, single)]
            found.append([sorted(map(str, f.collect())) for f in frames])
            # The bits of a large index are met before the join by key.
            assert all("BroadcastHashJoin [key" in plan(f) if sent else "BroadcastHashJoin [_word" in plan(f) for f in frames)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    entries = [Tech(f"Tool {i}", 2005, "", {"2": 2003}, (f"tool {i}",)) for i in range(5)]
    assert found[0] == found[1] and found[0][0] == sorted(map(str, audit.violations(docs, entries).drop("snippet").collect()))
    for f, asked in ((found[0][1], words), (found[0][2], single)):
        list_of = [r.word for r in asked.collect()]
        assert f == sorted(map(str, docs.select("doc_id", "text", T.find_keywords(F.col("text"), list_of).alias("skills")).collect()))
