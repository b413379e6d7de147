"""The registered queries, each over whole tables, and DuckDB SQL that gives the same rows.

Arrays are joined to strings and doubles rounded, so rows compare exactly.
DuckDB's engine has no lookaround: its patterns consume the characters about a
word, and test existence only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vocabulary import IMPLIED_PROMPT, NO_SKILLS
from ..operators import audit, categories, mining, ontology, scoring, skillindex, skills
from ..operators.ontology import Tech
from ..operators.shared import folder
from ..sources import crawl, files
from .pipelines import ClaimAudit, ImpliedSkills, requirements, sample

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Words that occur in the test documents, standing in for skills.
WORDS = ("the", "and", "that", "was", "for", "with", "this", "are", "from", "rest", "apache")
PHRASES = ("of the", "the", "of")
RECALL_OF = ("the", "and", "rest", "apache", "python", "The", "")
CATEGORY_RULES = (("metal", ("STEEL", "TIN", "COPPER", "NICKEL", "BRASS")), ("promo", ("promo",)), ("small", ("small",)), ("euro-name", ("é",)))
ALIASES = {"purchase": "buy", "click": "tap", "view": "look", "signup": "join"}
#: Brands as technologies: the year each was first sold, and its versions.
BRANDS = tuple(Tech(f"Brand#{i}", 1991 + i % 11, "brand", {"3": 1995 + i % 7} if i % 2 else {}) for i in (11, 12, 13, 14, 15, 21, 22, 23, 24, 25, 31, 32, 33, 34, 35, 41, 42, 43, 44, 45, 51, 52, 53, 54, 55))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _values(words) -> str:
    return ", ".join("('" + w.replace("'", "''") + "')" for w in words)


_FOUND = f"""
words(skill) AS (VALUES {_values(WORDS)}),
found AS (SELECT d.doc_id, d.lang, w.skill FROM documents d, words w
  WHERE regexp_matches(d.text, '(?i)(^|[^a-zA-Z0-9])' || w.skill || '([^a-zA-Z0-9]|$)')),
total AS (SELECT count(*) AS n FROM documents WHERE regexp_matches(text, '\\S'))
"""


@query(f"WITH {_FOUND} SELECT skill, count(*) AS doc_count FROM found GROUP BY skill")
def skill_doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skills.document_frequency(table(spark, sf_dir, "documents"), WORDS)


@query(f"WITH {_FOUND} SELECT skill, count(*) AS doc_count FROM found GROUP BY skill ORDER BY doc_count DESC, skill LIMIT 5")
def skill_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skills.top(skills.document_frequency(table(spark, sf_dir, "documents"), WORDS), 5)


@query(f"""WITH {_FOUND}, by_lang AS (SELECT lang, count(*) AS n FROM documents WHERE regexp_matches(text, '\\S') GROUP BY lang)
SELECT f.lang, f.skill, count(*) AS doc_count, round(count(*) / any_value(b.n), 6) AS frequency FROM found f JOIN by_lang b ON f.lang = b.lang GROUP BY f.lang, f.skill""")
def skill_freq_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counts, total = skills.document_frequency(docs, WORDS, by=("lang",)), skills.total_documents(docs, by=("lang",))
    return counts.join(total, "lang").select("lang", "skill", "doc_count", F.round(F.col("doc_count") / F.col("total_docs"), 6).alias("frequency"))


@query(f"""WITH {_FOUND}, counts AS (SELECT skill, count(*) AS n FROM found GROUP BY skill), asked(skill) AS (VALUES {_values(RECALL_OF)})
SELECT round(avg(CASE WHEN coalesce(c.n, 0) / (SELECT n FROM total) >= 0.005 THEN 1.0 ELSE 0.0 END), 6) AS recall FROM asked a LEFT JOIN counts c ON lower(a.skill) = c.skill WHERE a.skill <> ''""")
def recall_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    asked = spark.createDataFrame([(s,) for s in RECALL_OF], "skill string")
    return skills.recall_proxy(asked, skills.document_frequency(docs, WORDS), skills.total_documents(docs)).select(F.round("recall", 6).alias("recall"))


@query("""WITH texts AS (SELECT doc_id, text, regexp_replace(text, '(?i)of the', '#', 'g') AS rest FROM documents),
hits AS (SELECT doc_id, 'of the' AS skill FROM texts WHERE regexp_matches(text, '(?i)(^|[^a-zA-Z0-9])of the([^a-zA-Z0-9]|$)')
UNION ALL SELECT doc_id, 'the' FROM texts WHERE regexp_matches(regexp_replace(regexp_replace(text, '(?i)([^a-zA-Z0-9])', '\\1\\1', 'g'), '(?i)(^|[^a-zA-Z0-9])of[ ][ ]the([^a-zA-Z0-9]|$)', '\\1#\\2', 'g'), '(?i)(^|[^a-zA-Z0-9])the([^a-zA-Z0-9]|$)')
UNION ALL SELECT doc_id, 'of' FROM texts WHERE regexp_matches(regexp_replace(regexp_replace(text, '(?i)([^a-zA-Z0-9])', '\\1\\1', 'g'), '(?i)(^|[^a-zA-Z0-9])of[ ][ ]the([^a-zA-Z0-9]|$)', '\\1#\\2', 'g'), '(?i)(^|[^a-zA-Z0-9])of([^a-zA-Z0-9]|$)'))
SELECT skill, count(*) AS doc_count FROM hits GROUP BY skill""")
def overlap_alternation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longer phrases consume the words within them."""
    return skills.document_frequency(table(spark, sf_dir, "documents"), PHRASES)


def _baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of the part types in each order, but numbers."""
    words = F.explode(F.split("p_type", " ")).alias("item")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.select("l_orderkey", words).groupBy("l_orderkey").agg(F.collect_set("item").alias("items"))


_BASKETS = """
b AS (SELECT DISTINCT l_orderkey AS o, unnest(string_split(p_type, ' ')) AS item FROM lineitem JOIN part ON l_partkey = p_partkey),
total AS (SELECT count(DISTINCT o) AS n FROM b)
"""
_SETS = f"""{_BASKETS},
s1 AS (SELECT item AS a, count(*) AS f FROM b GROUP BY item HAVING count(*) >= 0.05 * (SELECT n FROM total)),
g AS (SELECT o, item FROM b WHERE item IN (SELECT a FROM s1)),
s2 AS (SELECT x.item AS a, y.item AS b, count(*) AS f FROM g x JOIN g y ON x.o = y.o AND x.item < y.item GROUP BY ALL HAVING count(*) >= 0.05 * (SELECT n FROM total)),
s3 AS (SELECT x.item AS a, y.item AS b, z.item AS c, count(*) AS f FROM g x JOIN g y ON x.o = y.o AND x.item < y.item JOIN g z ON x.o = z.o AND y.item < z.item GROUP BY ALL HAVING count(*) >= 0.05 * (SELECT n FROM total)),
s4 AS (SELECT x.item AS a, y.item AS b, z.item AS c, w.item AS d, count(*) AS f FROM g x JOIN g y ON x.o = y.o AND x.item < y.item JOIN g z ON x.o = z.o AND y.item < z.item JOIN g w ON x.o = w.o AND z.item < w.item GROUP BY ALL HAVING count(*) >= 0.05 * (SELECT n FROM total)),
s5 AS (SELECT x.item AS a, y.item AS b, z.item AS c, w.item AS d, v.item AS e, count(*) AS f FROM g x JOIN g y ON x.o = y.o AND x.item < y.item JOIN g z ON x.o = z.o AND y.item < z.item JOIN g w ON x.o = w.o AND z.item < w.item JOIN g v ON x.o = v.o AND w.item < v.item GROUP BY ALL HAVING count(*) >= 0.05 * (SELECT n FROM total)),
sets AS (SELECT [a] AS items, f FROM s1 UNION ALL SELECT [a, b], f FROM s2 UNION ALL SELECT [a, b, c], f FROM s3 UNION ALL SELECT [a, b, c, d], f FROM s4 UNION ALL SELECT [a, b, c, d, e], f FROM s5)
"""
_RULES = f"""{_SETS},
masks AS (SELECT items, f, unnest(range(1, (1 << len(items)) - 1)) AS mask FROM sets WHERE len(items) > 1),
split AS (SELECT [items[i] FOR i IN range(1, len(items) + 1) IF (mask >> (i - 1)) & 1 = 1] AS antecedent, [items[i] FOR i IN range(1, len(items) + 1) IF (mask >> (i - 1)) & 1 = 0] AS consequent, f FROM masks),
rules AS (SELECT antecedent, consequent, s.f / (SELECT n FROM total) AS support, s.f / x.f AS confidence, s.f * (SELECT n FROM total) / (x.f * y.f) AS lift
  FROM split s JOIN sets x ON x.items = s.antecedent JOIN sets y ON y.items = s.consequent WHERE s.f / x.f >= 0.2)
"""
_RULE_COLUMNS = "array_to_string(antecedent, ',') AS antecedent, array_to_string(consequent, ',') AS consequent, round(support, 6) AS support, round(confidence, 6) AS confidence, round(lift, 6) AS lift"


@query(f"WITH {_BASKETS} SELECT item, count(*) AS n, round(count(*) / (SELECT n FROM total), 6) AS share FROM b GROUP BY item")
def basket_skill_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skills.item_counts(_baskets(spark, sf_dir)).withColumn("share", F.round("share", 6))


@query(f"WITH {_SETS} SELECT array_to_string(items, ',') AS items, f AS freq, round(f / (SELECT n FROM total), 6) AS support FROM sets")
def freq_itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.itemsets(_baskets(spark, sf_dir), 0.05).select(F.array_join("items", ",").alias("items"), "freq", F.round("support", 6).alias("support"))


def _flat(rules: DataFrame) -> DataFrame:
    return rules.select(F.array_join("antecedent", ",").alias("antecedent"), F.array_join("consequent", ",").alias("consequent"), *(F.round(c, 6).alias(c) for c in ("support", "confidence", "lift")))


@query(f"WITH {_RULES} SELECT {_RULE_COLUMNS} FROM rules")
def assoc_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(mining.mined(_baskets(spark, sf_dir), 0.05, 0.2))


@query(f"WITH {_RULES} SELECT {_RULE_COLUMNS} FROM rules ORDER BY rules.confidence DESC, rules.lift DESC, rules.antecedent, rules.consequent LIMIT 20")
def top_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(mining.top_rules(mining.mined(_baskets(spark, sf_dir), 0.05, 0.2), 20))


@query(f"WITH {_RULES} SELECT DISTINCT item FROM (SELECT unnest(consequent) AS item FROM rules WHERE list_has_all(['PROMO', 'SMALL'], antecedent)) WHERE item NOT IN ('PROMO', 'SMALL')")
def implied_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.implied(mining.mined(_baskets(spark, sf_dir), 0.05, 0.2), ("PROMO", "SMALL"))


@query(f"""WITH {_RULES}, targets AS (SELECT p_partkey, string_split(p_type, ' ') AS items FROM part)
SELECT DISTINCT p_partkey, item FROM (SELECT p_partkey, items, unnest(consequent) AS item FROM targets JOIN rules ON list_has_all(items, antecedent)) WHERE NOT list_contains(items, item)""")
def implied_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules add to each part's own words."""
    targets = table(spark, sf_dir, "part").select("p_partkey", F.split("p_type", " ").alias("items"))
    return mining.implied_each(mining.mined(_baskets(spark, sf_dir), 0.05, 0.2), targets, "p_partkey")


@query("""SELECT p_partkey, CASE WHEN p_type IS NULL OR p_type = '' THEN 'none'
WHEN regexp_matches(p_type, '(?i)(^|[^a-z0-9])(steel|tin|copper|nickel|brass)([^a-z0-9]|$)') THEN 'metal'
WHEN regexp_matches(p_type, '(?i)(^|[^a-z0-9])promo([^a-z0-9]|$)') THEN 'promo'
WHEN regexp_matches(p_type, '(?i)(^|[^a-z0-9])small([^a-z0-9]|$)') THEN 'small'
WHEN contains(lower(p_type), 'é') THEN 'euro-name' ELSE 'other' END AS category FROM part""")
def category_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.normalize_category(F.col("p_type"), CATEGORY_RULES, "none", "other").alias("category"))


@query("""SELECT p_partkey, CASE WHEN p_name IS NULL OR p_name = '' THEN '미분류'
WHEN regexp_matches(p_name, '(?i)(^|[^a-z0-9])(ai|ml|it|devops|se|qa|sw|engineer)([^a-z0-9]|$)') THEN 'IT/개발'
WHEN regexp_matches(p_name, '(?i)(^|[^a-z0-9])(r&d|rd)([^a-z0-9]|$)') THEN 'R&D'
WHEN regexp_matches(p_name, '(?i)(^|[^a-z0-9])(ux|ui)([^a-z0-9]|$)') THEN '디자인'
WHEN regexp_matches(p_name, '(?i)(^|[^a-z0-9])hr([^a-z0-9]|$)') THEN '인사'
WHEN regexp_matches(p_name, '(?i)(^|[^a-z0-9])(pm|po)([^a-z0-9]|$)') THEN '기획'
WHEN regexp_matches(p_name, '(?i)(^|[^a-z0-9])(a/s|cs)([^a-z0-9]|$)') THEN '고객'
WHEN regexp_matches(p_name, '(?i)(^|[^a-z0-9])scm([^a-z0-9]|$)') THEN '물류/SCM' ELSE '기타' END AS category FROM part""")
def job_category_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The built-in rules, over part names."""
    return table(spark, sf_dir, "part").select("p_partkey", T.normalize_category(F.col("p_name")).alias("category"))


@query("""SELECT token, count(*) AS n FROM (SELECT CASE lower(trim(event_type)) WHEN 'purchase' THEN 'buy' WHEN 'click' THEN 'tap' WHEN 'view' THEN 'look' WHEN 'signup' THEN 'join' ELSE lower(trim(coalesce(event_type, ''))) END AS token FROM events) GROUP BY token""")
def alias_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(T.normalize_skill(F.col("event_type"), ALIASES).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def _order_sentence() -> Column:
    return F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" in "), F.year("o_orderdate").cast("string"), F.lit(". Served 3년 이상, v"), (F.col("o_custkey") % 9).cast("string"), F.lit(".2 since "), F.col("o_orderkey").cast("string"), F.lit("x."))


@query("""SELECT o_orderkey,
concat_ws(',', CASE WHEN o_orderkey BETWEEN 1980 AND 2029 THEN cast(o_orderkey AS VARCHAR) END, cast(year(o_orderdate) AS VARCHAR)) AS years,
'3' AS experience, concat_ws(',', cast(o_orderkey AS VARCHAR), cast(year(o_orderdate) AS VARCHAR), cast(o_custkey % 9 AS VARCHAR) || '.2') AS versions FROM orders""")
def numeric_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", _order_sentence().alias("s"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return rows.select("o_orderkey", joined(T.claim_years(F.col("s"))).alias("years"), joined(T.experience_years(F.col("s"))).alias("experience"), joined(T.version_tokens(F.col("s"))).alias("versions"))


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence for each order line: the year of the order and the brand that was sold, at version 1 to 7."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    sentence = F.concat(F.lit("In "), F.year("o_orderdate").cast("string"), F.lit(" we sold "), F.col("p_brand"), F.lit(" v"), F.col("l_linenumber").cast("string"), F.lit("."))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_custkey", sentence.alias("text"))


_BRAND_ROWS = ", ".join(f"('{t.name}', {t.released_year}, {t.versions.get('3', 'NULL')})" for t in BRANDS)
_CLAIMS = f"""
brands(name, released, v3) AS (VALUES {_BRAND_ROWS}),
claims AS (SELECT l_orderkey, l_linenumber, o_custkey, year(o_orderdate) AS y, p_brand, b.* FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey LEFT JOIN brands b ON p_brand = b.name),
bad AS (SELECT l_orderkey, l_linenumber, o_custkey, name AS tech, y AS claimed_year, released AS actual_year, 'release_year' AS kind FROM claims WHERE y < released
  UNION ALL SELECT l_orderkey, l_linenumber, o_custkey, name, y, v3, 'version_year' FROM claims WHERE l_linenumber = 3 AND y < v3)
"""


@query(f"WITH {_CLAIMS} SELECT l_orderkey, l_linenumber, tech, cast(claimed_year AS INTEGER) AS claimed_year, actual_year, kind FROM bad")
def claim_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _claims(spark, sf_dir).select("l_orderkey", "l_linenumber", F.explode(audit.violations_of(F.col("text"), BRANDS)).alias("v"))
    return rows.select("l_orderkey", "l_linenumber", "v.tech", "v.claimed_year", "v.actual_year", "v.kind")


@query(f"""WITH {_CLAIMS} SELECT l_orderkey, l_linenumber, kind, CASE kind WHEN 'release_year' THEN tech || '는 ' || actual_year || '년에 공개되었으나 문장은 ' ELSE tech || ' 3는 ' || actual_year || '년에 출시되었으나 문장은 ' END || claimed_year || '년을 주장합니다.' AS message FROM bad""")
def claim_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the audit says of each violation."""
    return audit.violations(_claims(spark, sf_dir).withColumn("line", F.struct("l_orderkey", "l_linenumber")), BRANDS, "line").select("line.l_orderkey", "line.l_linenumber", "kind", "message")


def _letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text for each customer: the sentences of all its orders' lines, in order."""
    each = _claims(spark, sf_dir).groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "text"))).alias("s"))
    return each.select("o_custkey", F.array_join("s.text", "\n").alias("text"))


_SCORES = f"""{_CLAIMS},
counted AS (SELECT o_custkey, sum(CASE WHEN y < released THEN 1 ELSE 0 END + CASE WHEN l_linenumber = 3 AND y < v3 THEN 1 ELSE 0 END) AS n,
  count(DISTINCT CASE WHEN y < released OR l_linenumber = 3 AND y < v3 THEN 'In ' || y || ' we sold ' || name || ' v' || l_linenumber || '.' END) AS spans FROM claims GROUP BY o_custkey),
scored AS (SELECT o_custkey, n, spans, 100 - least(60, 15 * n) AS score FROM counted)
"""


@query(f"WITH {_SCORES} SELECT o_custkey, cast(n AS INTEGER) AS n_violations, cast(spans AS INTEGER) AS n_spans, cast(score AS INTEGER) AS trust_score FROM scored")
def trust_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.report(_letters(spark, sf_dir), BRANDS).select("o_custkey", F.col("n_violations").cast("int").alias("n_violations"), F.size("suspect_spans").alias("n_spans"), "trust_score")


@query(f"WITH {_SCORES} SELECT CASE WHEN score >= 100 THEN '100' WHEN score >= 85 THEN '85-99' WHEN score >= 70 THEN '70-84' ELSE '<70' END AS bucket, count(*) AS n FROM scored GROUP BY 1")
def trust_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ClaimAudit(BRANDS, key="o_custkey").run(_letters(spark, sf_dir)).groupBy(F.col("trust_bucket").alias("bucket")).agg(F.count("*").alias("n"))


@query(f"""WITH {_SCORES},
wrong AS (SELECT name AS tech, 'release_year' AS kind FROM claims WHERE y < released UNION ALL SELECT name, 'version_year' FROM claims WHERE l_linenumber = 3 AND y < v3),
facets AS (SELECT 'documents' AS facet, 'all' AS value, count(*) AS n FROM scored HAVING count(*) > 0 UNION ALL SELECT 'documents', 'with violations', count(*) FROM scored WHERE n > 0 HAVING count(*) > 0
UNION ALL SELECT 'bucket', CASE WHEN score >= 100 THEN '100' WHEN score >= 85 THEN '85-99' WHEN score >= 70 THEN '70-84' ELSE '<70' END, count(*) FROM scored GROUP BY 2
UNION ALL SELECT 'tech', tech, count(*) FROM wrong GROUP BY 2 UNION ALL SELECT 'kind', kind, count(*) FROM wrong GROUP BY 2)
SELECT facet, value, n, round(n / (SELECT count(*) FROM scored), 6) AS share FROM facets""")
def violation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.summary(audit.report(_letters(spark, sf_dir), BRANDS)).withColumn("share", F.round("share", 6))


@query("""SELECT doc_id, cast(len(list_filter([trim(x, ' \t\n\r') FOR x IN regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1\n', 'g'), '\\n+')], lambda x: x <> '')) AS INTEGER) AS n_audit,
cast(len(list_filter([trim(x, ' \t\n\r') FOR x IN regexp_split_to_array(text, '[.!?\\n]+')], lambda x: length(x) > 5)) AS INTEGER) AS n_detector FROM documents""")
def sentence_split_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.audit_sentences(text)).alias("n_audit"), F.size(T.detector_sentences(text)).alias("n_detector"))


@query("""SELECT user_id, round(avg(value), 4) AS perplexity, round(coalesce(stddev_samp(value), 0), 4) AS burstiness,
round_even(0.6 * greatest(0, least(1, (60 - avg(value)) / 60)) + 0.4 * greatest(0, least(1, (15 - coalesce(stddev_samp(value), 0)) / 15)), 3) AS ai_probability FROM events WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY user_id""")
def ai_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values stand in for the perplexities of a user's sentences."""
    rows = scoring.aggregated(table(spark, sf_dir, "events").select("user_id", "value"), "user_id", "value")
    return rows.select("user_id", F.round("perplexity", 4).alias("perplexity"), F.round("burstiness", 4).alias("burstiness"), "ai_probability")


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 3 THEN '' ELSE trim(c_mktsegment) || ',' || c_name END AS implied FROM customer""")
def implicit_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as a model might give them: a list in the last line, over two lines, or broken."""
    listed = F.to_json(F.array(F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit(" ")), F.lit("  "), F.col("c_name")))
    kind = F.col("c_custkey") % 4
    answer = F.when(kind == 0, F.concat(F.lit("Thinking [1].\nIMPLICIT: "), listed)).when(kind == 1, F.concat(F.lit("IMPLICIT:\n"), F.replace(listed, F.lit('",'), F.lit('",\n')))).when(kind == 2, F.concat(F.lit("x IMPLICIT: "), listed, F.lit("\nIMPLICIT: [\"no\"]"))).otherwise(F.lit("IMPLICIT: [broken"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(T.parse_implied(answer), ",").alias("implied"))


@query("""SELECT doc_id, cast(len(lines) AS INTEGER) AS n_lines, md5(array_to_string(lines, chr(10))) AS digest FROM (SELECT doc_id, list_filter([trim(x, ' -•·*' || chr(9)) FOR x IN string_split(text, chr(10))], lambda x: x <> '') AS lines FROM documents)""")
def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = T.clean_lines(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(lines).alias("n_lines"), F.md5(F.array_join(lines, "\n").cast("binary")).alias("digest"))


@query("SELECT lower(p_name) AS name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def dup_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ontology.duplicated(table(spark, sf_dir, "part"), "p_name")


@query("SELECT p_brand AS category, count(*) AS n FROM part GROUP BY 1")
def category_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ontology.category_histogram(table(spark, sf_dir, "part").withColumnRenamed("p_brand", "category"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT c_custkey FROM customer)")
def unseen_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return crawl.unseen(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), seen)


@query("SELECT source, count(*) AS n, cast(sum(length(text)) AS BIGINT) AS chars FROM (SELECT 'conversation' AS source, text FROM conversations UNION ALL SELECT 'document', text FROM documents) WHERE regexp_matches(text, '\\S') GROUP BY source")
def union_nonempty(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select(F.lit("conversation").alias("source"), "text")
    both = said.unionByName(table(spark, sf_dir, "documents").select(F.lit("document").alias("source"), "text"))
    return skills.with_text(both).groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


_PROMPT = [x.replace("'", "''") for x in (IMPLIED_PROMPT.partition("{job_text}")[0], IMPLIED_PROMPT.partition("{job_text}")[2].partition("{explicit_skills}")[0], IMPLIED_PROMPT.partition("{explicit_skills}")[2])]


@query(f"""SELECT doc_id, md5('{_PROMPT[0]}' || regexp_replace(text, '^\\s+|\\s+$', '', 'g') || '{_PROMPT[1]}' || CASE WHEN doc_id % 2 = 0 THEN source || ', ' || lang ELSE '{NO_SKILLS}' END || '{_PROMPT[2]}') AS digest FROM documents""")
def implied_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt for each document, with its source and language for skills, or without any."""
    skills = F.when(F.col("doc_id") % 2 == 0, F.array("source", "lang")).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.implied_prompt(F.col("text"), skills).cast("binary")).alias("digest"))


class Spotter:
    """Stands in for an entity model: it finds a certificate in texts with "apache", and other things everywhere."""

    def __call__(self) -> Callable[[list[str]], list[list[dict]]]:
        entity = lambda group, word: {"entity_group": group, "word": word, "score": 0.5, "start": 0, "end": 1}
        return lambda texts: [[entity("PER", "someone"), entity("QT", " "), *([entity("CVL", "certificate")] if "apache" in t else [])] for t in texts]


@query(f"""SELECT doc_id, array_to_string(list_sort(list_filter([{", ".join(f"'{w}'" for w in sorted(WORDS))}], lambda w: regexp_matches(text, '(?i)(^|[^a-zA-Z0-9])' || w || '([^a-zA-Z0-9]|$)'))), ',') AS tech_stack,
CASE WHEN doc_id % 3 = 0 THEN '' ELSE (doc_id % 7)::VARCHAR || ',' || (doc_id % 11)::VARCHAR END AS years, CASE WHEN contains(text, 'apache') THEN 'certificate' ELSE '' END AS qualifications,
cast(CASE WHEN contains(text, 'apache') THEN 3 ELSE 2 END AS INTEGER) AS n_entities FROM documents""")
def document_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit requirements of each document, to which two of three state years of experience; a stand-in finds entities."""
    key = F.col("doc_id")
    years = F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("\n경력 "), (key % 7).cast("string"), F.lit("년 이상, "), (key % 11).cast("string"), F.lit(" 년차")))
    rows = requirements(table(spark, sf_dir, "documents").select(key, F.concat("text", years).alias("text")), words=WORDS, ner=Spotter())
    flat = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return rows.select("doc_id", flat("tech_stack").alias("tech_stack"), flat("experience_years").alias("years"), flat("qualifications").alias("qualifications"), F.size("raw_entities").alias("n_entities"))


_POSTINGS = """posting AS (SELECT p_partkey, p_name, p_type, lower(trim(p_brand)) AS tag FROM part)"""


@query(f"""WITH {_POSTINGS} SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(
  list_filter(['steel', 'tin', 'copper'], lambda k: regexp_matches(p_name || ' ' || p_type, '(?i)(^|[^a-zA-Z0-9])' || k || '([^a-zA-Z0-9]|$)')), [tag]))), ',') AS skills FROM posting""")
def posting_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords of a text, united with normalised tags."""
    text = F.concat_ws(" ", "p_name", "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.posting_skills(text, F.array("p_brand"), ("steel", "tin", "copper")), ",").alias("skills"))


@query(f"""WITH asked AS (SELECT DISTINCT p_brand AS asked FROM part), brands(name, year) AS (VALUES {", ".join(f"('{t.name.upper() if i % 2 else t.name}', {t.released_year})" for i, t in enumerate(BRANDS[::2]))})
SELECT asked, name, coalesce(year, 0) AS released_year FROM asked LEFT JOIN brands ON lower(asked) = lower(name)""")
def ontology_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands looked up among the entries of an ontology that holds every other one."""
    rows = [(t.name.upper() if i % 2 else t.name, t.released_year, t.category, t.versions, [t.name], i) for i, t in enumerate(BRANDS[::2])]
    known = spark.createDataFrame(rows, "name string, released_year int, category string, versions map<string,int>, aliases array<string>, position int")
    asked = table(spark, sf_dir, "part").select(F.col("p_brand").alias("asked")).distinct()
    found = ontology.lookup(asked, known)
    year = known.select(F.col("name"), "released_year")
    return found.join(year, "name", "left").select("asked", "name", F.coalesce("released_year", F.lit(0)).alias("released_year"))


@query("SELECT doc_id, replace(substr(text, 1, 120), chr(10), ' ') AS preview FROM documents")
def snippet_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


def _part_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as postings: every third has a category of technology, every other one of the rest a title of it."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key, F.col("p_name").alias("raw_text"), F.split("p_type", " ").alias("responsibilities"), F.lit(None).cast("array<string>").alias("requirements"), F.array("p_brand").alias("preferred"),
        F.when(key % 3 == 0, "백엔드 개발").otherwise("영업").alias("category"), F.when(key % 2 == 0, "Data Engineer 데이터").otherwise("sales").alias("job_title"), F.array("p_brand").alias("skills"),
    )


@query("SELECT p_partkey, p_name || ' ' || p_type || ' ' || p_brand AS text FROM part")
def posting_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of a posting's text in one string; a missing list adds nothing."""
    rows = _part_postings(spark, sf_dir)
    return rows.select("p_partkey", files.posting_text(rows).alias("text"))


@query("""WITH items AS (SELECT array_to_string(list_sort(list_distinct(list_concat(list_filter(['steel', 'tin', 'copper', 'small', 'large'],
  lambda k: regexp_matches(p_name || ' ' || p_type || ' ' || p_brand, '(?i)(^|[^a-zA-Z0-9])' || k || '([^a-zA-Z0-9]|$)')), [lower(p_brand)]))), ',') AS items FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 2 = 0)
SELECT items, count(*) AS n FROM items WHERE contains(items, ',') GROUP BY 1""")
def it_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skill sets of postings of technology that have two skills at least."""
    rows = skills.transactions(_part_postings(spark, sf_dir), it_only=True, words=("steel", "tin", "copper", "small", "large"))
    return rows.groupBy(F.array_join("items", ",").alias("items")).agg(F.count("*").alias("n"))


@query("""WITH sections AS (SELECT conv_id, string_agg('[' || turn || '] ' || role || chr(10) || text, chr(10) || chr(10) ORDER BY turn, role, text) || ' ' || CASE WHEN conv_id % 2 = 0 THEN 'cert' ELSE '' END AS text FROM conversations WHERE text IS NOT NULL GROUP BY conv_id)
SELECT conv_id, md5(text) AS digest FROM sections""")
def resume_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as résumés: turns for sections, a certification for every other one."""
    turns = table(spark, sf_dir, "conversations").where("text is not null")
    section = F.struct("turn", "role", "text")
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(section)).alias("s"))
    named = F.transform("s", lambda t: F.struct(t["turn"].cast("string").alias("number"), t["role"].alias("question"), t["text"].alias("answer")))
    spec = F.struct(F.when(F.col("conv_id") % 2 == 0, "cert").alias("certifications"))
    rows = files.index_text(rows.select("conv_id", named.alias("sections"), spec.alias("pass_spec")))
    return rows.select("conv_id", F.md5(F.col("text").cast("binary")).alias("digest"))


#: Korean names of technologies, and what follows the name: particles, or letters that make another word of it.
KOREAN = (Tech("스프링", 1994, "framework"), Tech("도커", 1996, "tool", {}, ("docker",)))
FOLLOWS = ("을", "에서", "부트", " ", "docker")


@query("""WITH claims AS (SELECT o_orderkey, year(o_orderdate) AS y, o_orderkey % 2 AS tool, o_orderkey % 5 AS f FROM orders),
named AS (SELECT o_orderkey, y, '스프링' AS tech, 1994 AS released FROM claims WHERE tool = 0 AND f IN (0, 1, 3, 4)
  UNION ALL SELECT o_orderkey, y, '도커', 1996 FROM claims WHERE tool = 1 AND f IN (0, 1, 3) OR f = 4)
SELECT o_orderkey, tech, cast(y AS INTEGER) AS claimed_year, released AS actual_year FROM named WHERE y < released""")
def korean_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Korean names count with particles or Latin letters after them, but not as part of a longer Korean word; a Latin alias may follow Korean letters."""
    key = F.col("o_orderkey")
    follows = F.array(*map(F.lit, FOLLOWS))[(key % 5).cast("int")]
    text = F.concat(F.year("o_orderdate").cast("string"), F.lit("년에 "), F.when(key % 2 == 0, "스프링").otherwise("도커"), follows, F.lit(" 썼다."))
    rows = table(spark, sf_dir, "orders").select(key, F.explode(audit.violations_of(text, KOREAN)).alias("v"))
    return rows.select("o_orderkey", "v.tech", "v.claimed_year", "v.actual_year")


@query("SELECT o_orderkey, cast(greatest(0, 100 - least(60, 15 * (o_orderkey % 6)) - CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE round_even(30 * ((o_orderkey % 101) / 100.0::DOUBLE), 0) END) AS INTEGER) AS trust_score FROM orders")
def trust_of_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all mixtures of violations and generated text; some have no probability."""
    key = F.col("o_orderkey")
    probability = F.when(key % 7 != 0, (key % 101) / 100.0)
    return table(spark, sf_dir, "orders").select(key, T.trust_score((key % 6).cast("int"), probability).alias("trust_score"))


@query("SELECT count(DISTINCT lower(p_name)) AS n FROM part")
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ontology.unique_names(table(spark, sf_dir, "part").select(F.col("p_name").alias("name")))


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 20")
def first_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of a stable order."""
    return sample(table(spark, sf_dir, "orders"), 20, "o_orderdate", "o_orderkey").select("o_orderkey", "o_custkey")


# Tables in place of lists: vocabularies, ontologies and rules of any size.

_RUNS = "SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM benchmark"


@query(f"""WITH words AS ({_RUNS}), found AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS skill FROM documents)
SELECT skill, count(*) AS doc_count FROM found WHERE skill IN (SELECT word FROM words) GROUP BY skill""")
def vocabulary_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many documents each word of the benchmark occurs."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("word")).distinct()
    return skills.document_frequency(table(spark, sf_dir, "documents"), words)


@query(ORACLE_SQL["overlap_alternation"])
def overlap_of_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """overlap_alternation by a table of phrases."""
    return skills.document_frequency(table(spark, sf_dir, "documents"), spark.createDataFrame([(p,) for p in PHRASES], "word string"))


def _part_ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as a technology, with a Korean alias and a third version."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.format_string("Item %07d", key).alias("name"), (1991 + key % 9).cast("int").alias("released_year"), F.col("p_type").alias("category"), F.create_map(F.lit("3"), (1995 + F.col("p_size") % 7).cast("int")).alias("versions"),
        F.array(F.concat(key.cast("string"), F.lit("번 품목"))).alias("aliases"), key.cast("int").alias("position"),
    )


@query("""WITH claims AS (SELECT l_orderkey, l_linenumber, year(o_orderdate) AS y, printf('Item %07d', p_partkey) AS tech, 1991 + p_partkey % 9 AS released, 1995 + p_size % 7 AS v3 FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, l_linenumber, tech, cast(y AS INTEGER) AS claimed_year, cast(released AS INTEGER) AS actual_year, 'release_year' AS kind FROM claims WHERE y < released
UNION ALL SELECT l_orderkey, l_linenumber, tech, cast(y AS INTEGER), cast(v3 AS INTEGER), 'version_year' FROM claims WHERE l_linenumber = 3 AND y < v3""")
def part_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence for each order line, audited against an ontology of all parts; every other line uses the Korean alias."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    named = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.col("l_partkey").cast("string"), F.lit("번 품목을"))).otherwise(F.format_string("iTEM %07d", F.col("l_partkey")))
    text = F.concat(F.lit("In "), F.year("o_orderdate").cast("string"), F.lit(" we sold "), named, F.lit(" v"), F.col("l_linenumber").cast("string"), F.lit("."))
    found = audit.violations(lines.select(F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("line"), text.alias("text")), _part_ontology(spark, sf_dir), "line")
    return found.select("line.l_orderkey", "line.l_linenumber", "tech", "claimed_year", "actual_year", "kind")


@query(ORACLE_SQL["claim_audit"])
def claim_audit_of_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """claim_audit by a table of brands."""
    rows = [(t.name, t.released_year, t.category, t.versions, list(t.aliases), i) for i, t in enumerate(BRANDS)]
    known = spark.createDataFrame(rows, "name string, released_year int, category string, versions map<string,int>, aliases array<string>, position int")
    found = audit.violations(_claims(spark, sf_dir).withColumn("line", F.struct("l_orderkey", "l_linenumber")), known, "line")
    return found.select("line.l_orderkey", "line.l_linenumber", "tech", "claimed_year", "actual_year", "kind")


@query(f"""WITH {_RULES}, top AS (SELECT antecedent, consequent FROM rules ORDER BY rules.confidence DESC, rules.lift DESC, rules.antecedent, rules.consequent LIMIT 20),
targets AS (SELECT DISTINCT o, list(item) AS items FROM b GROUP BY o)
SELECT DISTINCT l_orderkey, item FROM (SELECT o AS l_orderkey, items, unnest(consequent) AS item FROM targets JOIN top ON list_has_all(items, antecedent)) WHERE NOT list_contains(items, item)""")
def implied_of_top_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the twenty best rules add to each order's words."""
    baskets = _baskets(spark, sf_dir)
    return mining.implied_each(mining.top_rules(mining.mined(baskets, 0.05, 0.2), 20), baskets, "l_orderkey")


@query(ORACLE_SQL["category_normalize"])
def category_of_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """category_normalize by a table of rules."""
    rules = spark.createDataFrame([(i, c, list(words)) for i, (c, words) in enumerate(CATEGORY_RULES)], "position int, category string, patterns array<string>")
    found = categories.categorized(table(spark, sf_dir, "part"), categories.table(rules), "p_type", "found", "none", "other")
    return found.select("p_partkey", F.col("found").alias("category"))


@query("""WITH rules AS (SELECT lower(c_name) AS word, min(c_custkey) AS position, arg_min(c_mktsegment, c_custkey) AS category FROM customer GROUP BY 1),
asked AS (SELECT o_orderkey, o_custkey, o_custkey * 7 % (SELECT count(*) FROM customer) AS other FROM orders)
SELECT o_orderkey, CASE WHEN o_custkey <= other THEN a.category ELSE b.category END AS category FROM asked JOIN rules a ON a.position = o_custkey JOIN rules b ON b.position = other""")
def category_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that name two customers each; a rule for each customer, the first of which counts."""
    customer = table(spark, sf_dir, "customer")
    rules = customer.select(F.col("c_custkey").alias("position"), F.col("c_mktsegment").alias("category"), F.col("c_name").alias("pattern"))
    name = lambda key: F.format_string("CUSTOMER#%09d", key)
    text = F.concat(F.lit("for "), name(F.col("o_custkey")), F.lit(", "), name(F.col("o_custkey") * 7 % customer.agg(F.count("*")).scalar()), F.lit("에게"))
    found = categories.categorized(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")), rules, "text", "category")
    return found.select("o_orderkey", "category")


PART_WORDS = ("small", "large", "medium", "standard", "promo", "economy", "hot", "widget", "gear", "plate", "red", "blue", "bolt", "rod", "ring", "gizmo", "old", "cold", "anvil", "new")


class Assembler:
    """Stands in for a language model: anvils need assembly."""

    def complete(self, prompt: str) -> str:
        return 'Thinking.\nIMPLICIT: ["assembly"]' if "anvil" in prompt else "nothing"


@query(f"""WITH words AS (SELECT p_partkey, lower(p_name || ' ' || p_type) AS text, list_sort(list_distinct(list_filter(string_split(lower(p_name || ' ' || p_type), ' '), lambda w: w IN ({", ".join(f"'{w}'" for w in PART_WORDS)})))) AS items FROM part),
total AS (SELECT count(*) AS n FROM words),
b AS (SELECT p_partkey AS o, unnest(items) AS item FROM words),
sets AS (SELECT [item] AS items, count(*) AS f FROM b GROUP BY ALL HAVING count(*) >= 0.015 * (SELECT n FROM total)
  UNION ALL SELECT [x.item, y.item], count(*) FROM b x JOIN b y ON x.o = y.o AND x.item < y.item GROUP BY ALL HAVING count(*) >= 0.015 * (SELECT n FROM total)
  UNION ALL SELECT [x.item, y.item, z.item], count(*) FROM b x JOIN b y ON x.o = y.o AND x.item < y.item JOIN b z ON x.o = z.o AND y.item < z.item GROUP BY ALL HAVING count(*) >= 0.015 * (SELECT n FROM total)),
masks AS (SELECT items, f, unnest(range(1, (1 << len(items)) - 1)) AS mask FROM sets WHERE len(items) > 1),
split AS (SELECT [items[i] FOR i IN range(1, len(items) + 1) IF (mask >> (i - 1)) & 1 = 1] AS antecedent, [items[i] FOR i IN range(1, len(items) + 1) IF (mask >> (i - 1)) & 1 = 0] AS consequent, f FROM masks),
rules AS (SELECT antecedent, consequent FROM split s JOIN sets x ON x.items = s.antecedent WHERE s.f / x.f >= 0.15),
added AS (SELECT p_partkey, list_sort(list(DISTINCT item)) AS arm FROM (SELECT p_partkey, items, unnest(consequent) AS item FROM words JOIN rules ON list_has_all(items, antecedent)) WHERE NOT list_contains(items, item) GROUP BY p_partkey)
SELECT p_partkey, array_to_string(items, ',') AS explicit, '3' AS years, array_to_string(coalesce(arm, []), ',') AS implicit_arm, CASE WHEN contains(text, 'anvil') THEN 'assembly' ELSE '' END AS implicit_llm,
  array_to_string(list_sort(list_concat(coalesce(arm, []), CASE WHEN contains(text, 'anvil') THEN ['assembly'] ELSE [] END)), ',') AS implicit_union FROM words LEFT JOIN added USING (p_partkey)""")
def implied_of_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline for every part as a posting: what it states, what rules and a stand-in for a model add."""
    text = F.concat(F.col("p_name"), F.lit(" "), F.col("p_type"), F.lit(" 3년 이상"))
    postings = table(spark, sf_dir, "part").select("p_partkey", text.alias("text"))
    pipeline = ImpliedSkills(PART_WORDS, 0.015, 0.15, client=Assembler)
    found = pipeline.run_all(postings, pipeline.rules(postings), "p_partkey")
    flat = lambda c, name: F.array_join(c, ",").alias(name)
    return found.select("p_partkey", flat("tech_stack", "explicit"), flat(F.col("experience_years").cast("array<string>"), "years"), *(flat(c, c) for c in ("implicit_arm", "implicit_llm", "implicit_union")))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'Dev,' || o_orderpriority WHEN 1 THEN o_orderpriority ELSE '' END AS category, o_orderpriority AS job_title, CASE o_orderkey % 2 WHEN 0 THEN 'Seoul ' || o_custkey ELSE 'KR' END AS work_location,
o_orderpriority || chr(10) || 'intro' || chr(10) || '- one' || chr(10) || '• ' || o_orderstatus || chr(10) || chr(10) AS raw_text, 'one|' || o_orderstatus AS responsibilities, o_orderstatus AS skills, 'https://www.wanted.co.kr/wd/' || o_orderkey AS url FROM orders""")
def normalized_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the jobs of a postings service, made into postings."""
    key, other = F.col("o_orderkey"), lambda c, kind: F.lit(c).cast(kind)
    tag = F.when(key % 3 == 0, F.array(F.lit('{"title":"Dev"}'), F.col("o_orderpriority"))).when(key % 3 == 1, F.array(F.col("o_orderpriority"), F.lit("")))
    jobs = table(spark, sf_dir, "orders").select(
        key.alias("id"), F.col("o_orderpriority").alias("position"), other(None, "string").alias("due_time"), other(None, "int").alias("annual_from"), other(None, "int").alias("annual_to"),
        F.struct(F.col("o_custkey").alias("id"), F.lit("c").alias("name")).alias("company"), F.struct(F.when(key % 2 == 0, F.concat(F.lit("Seoul "), F.col("o_custkey").cast("string"))).otherwise("").alias("full_location"), F.lit("KR").alias("country")).alias("address"),
        F.struct(F.lit(" intro\n").alias("intro"), F.concat(F.lit("- one\n• "), F.col("o_orderstatus")).alias("main_tasks"), F.lit(" ").alias("requirements"), other(None, "string").alias("preferred_points")).alias("detail"),
        F.array(F.struct(F.col("o_orderstatus").alias("title")), F.struct(F.lit("").alias("title"))).alias("skill_tags"), tag.alias("category_tags"),
    )
    rows = files.normalized_jobs(jobs)
    return rows.select("meta.id", "category", "job_title", "work_location", "raw_text", F.array_join("responsibilities", "|").alias("responsibilities"), F.array_join("skills", "|").alias("skills"), "meta.url")


# Through files: tables written in the layouts that the readers take, and read back.


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {_FOUND} SELECT skill, count(*) AS doc_count, (SELECT n FROM total) AS total_docs FROM found GROUP BY skill")
def indexed_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index after all sources came, each second one twice, at first without most of its documents."""
    docs, path = table(spark, sf_dir, "documents").select("doc_id", "text", "source"), _scratch(spark, "skill-index")
    even = F.pmod(F.xxhash64("source"), F.lit(2)) == 0
    skillindex.update(docs.where((F.col("doc_id") % 5 == 0) | ~F.coalesce(even, F.lit(False))), path, WORDS, "source")
    skillindex.update(docs.where(even), path, WORDS, "source")
    return skillindex.frequency(spark, path).withColumn("total_docs", skillindex.total(spark, path).scalar())


@query("""WITH sections AS (SELECT conv_id, string_agg('[' || CASE WHEN turn = 0 THEN '' ELSE turn::VARCHAR END || '] ' || role || chr(10) || text, chr(10) || chr(10) ORDER BY turn, role, text) AS text, count(*) AS n FROM conversations WHERE text IS NOT NULL GROUP BY conv_id)
SELECT conv_id::VARCHAR AS url, CASE conv_id % 2 WHEN 0 THEN 'linkareer' ELSE 'naver_cafe' END AS source, n::INTEGER AS n_sections, md5(text) AS digest, CASE conv_id % 3 WHEN 0 THEN 'club' WHEN 1 THEN 'intern' ELSE '' END AS activities, 'job ' || conv_id AS title FROM sections WHERE conv_id % 4 <> 3""")
def stored_resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as résumés of two sites, in their keys, and read back; every fourth has no section."""
    key, path = F.col("conv_id"), _scratch(spark, "resumes")
    turn = F.struct(F.col("turn").alias("번호"), F.col("role").alias("질문"), F.col("text").alias("답변"))
    rows = table(spark, sf_dir, "conversations").where("text is not null").groupBy(key).agg(F.array_sort(F.collect_list(turn)).alias("s"))
    spec = F.struct(F.when(key % 3 == 0, "club").when(key % 3 == 1, "").alias("대외활동"), F.when(key % 3 == 1, "intern").alias("대외활동 경력 및 인턴"))
    rows = rows.select(key.cast("string").alias("url"), spec.alias("합격스펙"), F.when(key % 4 != 3, F.col("s")).alias("자소서"), F.concat(F.lit("job "), key.cast("string")).alias("title"), key)
    for part in (0, 1):
        files.write_lines(rows.where(key % 2 == part).drop("conv_id"), f"{path}/{part}")
    found = files.resumes(spark, f"{path}/0", f"{path}/1")
    digest = F.md5(files.full_text(F.col("sections")).cast("binary"))
    return found.select("url", "source", F.size("sections").alias("n_sections"), digest.alias("digest"), "pass_spec.activities", "meta.title")


@query("""WITH postings AS (SELECT 'jobkorea' AS source, o_orderpriority AS job_title, o_orderkey AS id FROM orders WHERE o_orderkey % 50 = 0 UNION ALL SELECT 'wanted', o_orderpriority, o_orderkey FROM orders WHERE o_orderkey % 50 <> 0)
SELECT source, job_title, count(*) AS n, sum(id)::BIGINT AS ids FROM postings GROUP BY source, job_title""")
def stored_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as postings, some as a company's positions, the others as lines with keys that no schema has; read back as one, meta open."""
    path, rows = _scratch(spark, "postings"), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    company = rows.where("o_orderkey % 50 = 0").groupBy("o_orderpriority").agg(F.collect_list(F.struct(F.col("o_orderpriority").alias("job_title"), F.col("o_orderkey").cast("string").alias("headcount"))).alias("positions"))
    # A file for each company.
    company.select(F.lit("u").alias("url"), F.struct(F.lit("Co").alias("name")).alias("company"), "positions", "o_orderpriority").write.partitionBy("o_orderpriority").json(f"{path}/company")
    files.write_lines(rows.where("o_orderkey % 50 <> 0").select(F.col("o_orderpriority").alias("job_title"), F.struct(F.struct(F.col("o_orderkey").alias("order")).alias("own")).alias("meta")), f"{path}/lines")
    found = files.postings(spark, f"{path}/company", f"{path}/lines", open_meta=True)
    files.write_lines(found, f"{path}/again")
    again = files.posting_lines(spark, f"{path}/again", open_meta=True)
    number = F.coalesce(F.try_variant_get("meta", "$.own.order", "bigint"), F.try_variant_get("meta", "$.headcount", "bigint"))
    return again.groupBy("source", "job_title").agg(F.count("*").alias("n"), F.sum(number).alias("ids"))


@query("""WITH brands AS (SELECT p_brand AS name, min(p_partkey) AS k FROM part GROUP BY p_brand)
SELECT name || ': bad released_year' AS message FROM brands WHERE k % 3 = 0
UNION ALL SELECT name || ' 1: bad version year' FROM brands WHERE k % 4 = 0
UNION ALL SELECT name || ': empty category' FROM brands WHERE k % 5 = 0
UNION ALL SELECT name || ': aliases must be a list' FROM brands WHERE k % 7 = 0
UNION ALL SELECT 'alias shared claimed by ' || string_agg(name, ', ' ORDER BY name) FROM brands WHERE k % 7 <> 0 AND k % 2 = 0 HAVING count(*) > 1""")
def ontology_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the check of an ontology says of one entry a brand, many of them broken."""
    key, path = F.col("k"), _scratch(spark, "ontology")
    brands = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(F.min("p_partkey").alias("k"))
    aliases = F.when(key % 7 == 0, '"none"').when(key % 2 == 0, '["Shared"]').otherwise("[]")
    entry = F.concat(
        F.lit('{"name": "'), F.col("name"), F.lit('", "released_year": '), F.when(key % 3 == 0, "1800").otherwise("2000"), F.lit(', "category": "'), F.when(key % 5 == 0, "").otherwise("c"),
        F.lit('", "versions": {"1": '), F.when(key % 4 == 0, '"x"').otherwise("2001"), F.lit('}, "aliases": '), aliases, F.lit("}"),
    )
    brands.agg(F.concat(F.lit("["), F.array_join(F.collect_list(entry), ", "), F.lit("]"))).coalesce(1).write.text(path)
    return ontology.problems(spark, path).select("message")


class Lengths:
    """Stands in for a perplexity model: a sentence's length, none for sentences with a comma."""

    def __call__(self) -> Callable[[list[str]], list[float]]:
        return lambda sentences: [float("nan") if "," in s else float(len(s)) for s in sentences]


@query("""WITH sentences AS (SELECT doc_id, unnest(list_filter([trim(x, ' \t\n\r') FOR x IN regexp_split_to_array(text, '[.!?\\n]+')], lambda x: length(x) > 5)) AS s FROM documents),
scored AS (SELECT doc_id, avg(length(s)) AS p, coalesce(stddev_samp(length(s)), 0) AS b FROM sentences WHERE NOT contains(s, ',') GROUP BY doc_id)
SELECT doc_id, round(p, 4) AS perplexity, round(b, 4) AS burstiness, CASE WHEN p IS NULL THEN 0 ELSE round_even(0.6 * greatest(0, least(1, (60 - p) / 60)) + 0.4 * greatest(0, least(1, (15 - b) / 15)), 3) END AS ai_probability FROM documents LEFT JOIN scored USING (doc_id)""")
def generated_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generated-text signal of each document by a stand-in for the model; none where no sentence has a score."""
    found = scoring.detected(table(spark, sf_dir, "documents").select("doc_id", "text"), Lengths())
    number = lambda c: F.when(~F.isnan(c), F.round(c, 4)).alias(c)
    return found.select("doc_id", number("perplexity"), number("burstiness"), "ai_probability")
