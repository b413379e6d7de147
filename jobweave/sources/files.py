"""Readers of posting and résumé files, and writers of JSON lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_lines, filled, or_empty, strip
from . import schemas


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path is there, in any store that Spark reads."""
    jvm = spark._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or folder, in any store that Spark reads; nothing if it isn't there."""
    jvm = spark._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def _none() -> Column:
    return F.array().cast("array<string>")


def _posting_meta(**values: Column) -> Column:
    return F.struct(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.POSTING_META]).alias("meta")


def company_positions(spark: SparkSession, path: str) -> DataFrame:
    """The positions in a company's file, one row each.  A missing file is an error.

    Skills stay empty: the file's own list is a union over all positions.
    """
    rows = spark.read.schema(schemas.COMPANY_FILE).json(path, multiLine=True, mode="FAILFAST").select("url", F.coalesce("company.name", F.lit("")).alias("company"), F.explode("positions").alias("p"))
    lists = {n: F.coalesce(F.col(f"p.{n}"), _none()) for n in ("responsibilities", "requirements", "preferred")}
    return rows.select(
        F.lit("jobkorea").alias("source"), "company", "p.category", "p.job_title", "p.work_location",
        F.array_join(F.concat(F.array("p.job_title"), *lists.values()), "\n").alias("raw_text"),
        *(c.alias(n) for n, c in lists.items()), _none().alias("skills"),
        _posting_meta(headcount=F.col("p.headcount"), url=F.col("url")),
    )


def posting_lines(spark: SparkSession, path: str, open_meta: bool = False) -> DataFrame:
    """Postings from JSON lines.  Blank lines are skipped, a malformed line is an error, a missing file is empty.

    Null texts and lists are empty; only a missing source becomes the default.
    With ``open_meta`` meta is a variant with all keys of the file, whatever they
    are, and is written back as it is; otherwise it has the known keys.
    """
    schema = schemas.OPEN_POSTING if open_meta else schemas.POSTING
    rows = spark.read.schema(schema).json(path, mode="FAILFAST") if exists(spark, path) else spark.createDataFrame([], schema)
    texts = [F.coalesce("source", F.lit("wanted")).alias("source"), *(or_empty(F.col(n)).alias(n) for n in ("company", "category", "job_title", "work_location", "raw_text"))]
    return rows.select(*texts, *(F.coalesce(n, _none()).alias(n) for n in ("responsibilities", "requirements", "preferred", "skills")), "meta")


def with_open_meta(postings: DataFrame) -> DataFrame:
    """postings with meta as a variant of the keys that have a value."""
    return postings.withColumn("meta", F.parse_json(F.to_json("meta")))


def postings(spark: SparkSession, company_path: str, lines_path: str, open_meta: bool = False) -> DataFrame:
    """All postings of both files, as far as they exist."""
    found = [company_positions(spark, company_path)] if exists(spark, company_path) else []
    found = [with_open_meta(f) for f in found] if open_meta else found
    return reduce(DataFrame.unionByName, [*found, posting_lines(spark, lines_path, open_meta)])


def _spec(raw: str) -> Column:
    get = lambda key: or_empty(F.col(f"{raw}.`{key}`"))
    activities = F.coalesce(F.nullif(get("대외활동"), F.lit("")), get("대외활동 경력 및 인턴"))
    return F.struct(get("학교").alias("school"), get("학과").alias("major"), get("학점").alias("gpa"), get("어학점수").alias("language"), get("자격증").alias("certifications"), activities.alias("activities"), get("경력").alias("career"))


def _sections(raw: str) -> Column:
    number = lambda s: F.when(s["번호"] == "0", "").otherwise(or_empty(s["번호"]))
    return F.transform(F.coalesce(F.col(raw), F.array().cast(schemas.RESUME_FILE["자소서"].dataType)), lambda s: F.struct(number(s).alias("number"), or_empty(s["질문"]).alias("question"), or_empty(s["답변"]).alias("answer")))


def resume_lines(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Résumés from JSON lines; a missing file is empty.  A section number of 0 is empty."""
    if exists(spark, path):
        rows = spark.read.schema(schemas.RESUME_FILE).json(path, mode="FAILFAST")
    else:
        rows = spark.createDataFrame([], schemas.RESUME_FILE)
    return rows.select(
        F.lit(source).alias("source"), or_empty(F.col("url")).alias("url"), or_empty(F.col("기업명")).alias("company"), or_empty(F.col("직무")).alias("job"), or_empty(F.col("지원시기")).alias("apply_period"),
        _spec("합격스펙").alias("pass_spec"), _sections("자소서").alias("sections"),
        F.struct("id", "title", "crawledAt", "scrapCount", "viewCount", "types").alias("meta"),
    )


def resumes(spark: SparkSession, linkareer_path: str, cafe_path: str, limit: int | None = None) -> DataFrame:
    """Résumés of both sources that have sections; with a limit, the first by source and url."""
    rows = resume_lines(spark, linkareer_path, "linkareer").unionByName(resume_lines(spark, cafe_path, "naver_cafe")).where(F.size("sections") > 0)
    return rows if limit is None else rows.orderBy("source", "url", "meta.id").limit(limit)


def full_text(sections: Column) -> Column:
    """Numbered questions and answers, a blank line between sections."""
    return F.array_join(F.transform(sections, lambda s: F.concat(F.lit("["), s["number"], F.lit("] "), s["question"], F.lit("\n"), s["answer"])), "\n\n")


def index_text(resumes: DataFrame) -> DataFrame:
    """resumes with text: the sections and the certifications; blank ones go."""
    return resumes.withColumn("text", F.concat(full_text(F.col("sections")), F.lit(" "), or_empty(F.col("pass_spec.certifications")))).where(strip(F.col("text")) != "")


def posting_text(postings: DataFrame) -> Column:
    """All of a posting's text in one string."""
    return F.array_join(F.concat(F.array(or_empty(F.col("raw_text"))), *(F.coalesce(F.col(n), _none()) for n in ("responsibilities", "requirements", "preferred"))), " ")


def normalized_jobs(jobs: DataFrame, site: str = "https://www.wanted.co.kr/wd/") -> DataFrame:
    """Jobs of the service (schema API_JOB) as postings."""
    part = {n: strip(or_empty(F.col(f"detail.{n}"))) for n in ("intro", "main_tasks", "requirements", "preferred_points")}
    title = F.transform(F.coalesce(F.col("category_tags"), _none()), lambda t: F.when(t.startswith("{"), F.get_json_object(t, "$.title")).otherwise(t))
    tags = F.transform(F.coalesce(F.col("skill_tags"), F.array().cast("array<struct<title:string>>")), lambda t: t["title"])
    place = F.coalesce(F.nullif(F.col("address.full_location"), F.lit("")), F.col("address.country"), F.lit(""))
    position = or_empty(F.col("position"))
    return jobs.select(
        F.lit("wanted").alias("source"), or_empty(F.col("company.name")).alias("company"), F.array_join(filled(title), ",").alias("category"), position.alias("job_title"), place.alias("work_location"),
        F.array_join(F.array(position, part["intro"], part["main_tasks"], part["requirements"], part["preferred_points"]), "\n").alias("raw_text"),
        clean_lines(part["main_tasks"]).alias("responsibilities"), clean_lines(part["requirements"]).alias("requirements"), clean_lines(part["preferred_points"]).alias("preferred"), filled(tags).alias("skills"),
        _posting_meta(id=F.col("id"), url=F.concat(F.lit(site), F.col("id").cast("string")), due_time=F.col("due_time"), annual_from=F.col("annual_from"), annual_to=F.col("annual_to"), company_id=F.col("company.id")),
    )


def write_lines(rows: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines; appended to or in place of what is there."""
    rows.write.mode("append" if append else "overwrite").json(path)


_RULES = "array<struct<category:string,patterns:array<string>>>"


def category_table(spark: SparkSession, path: str) -> DataFrame:
    """position, category, patterns of the rules in a JSON array of {category, patterns}, for ``categories.table``.

    A missing or malformed file is an error.
    """
    rules = spark.read.text(path, wholetext=True).select(F.from_json("value", _RULES, {"mode": "FAILFAST"}).alias("r"))
    return rules.select(F.posexplode("r").alias("position", "r")).select("position", "r.category", F.coalesce("r.patterns", _none()).alias("patterns"))


def category_rules(spark: SparkSession, path: str) -> list[tuple[str, list[str]]]:
    """The same rules as a list, in the file's order, for ``normalize_category``."""
    return [(r.category, list(r.patterns)) for r in category_table(spark, path).orderBy("position").collect()]
