"""Schemas of postings, résumés and ontology entries."""

from pyspark.sql import types as T

_TEXTS = T.ArrayType(T.StringType())


def _struct(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


POSTING_META = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("due_time", T.StringType()),
    T.StructField("annual_from", T.IntegerType()), T.StructField("annual_to", T.IntegerType()), T.StructField("company_id", T.LongType()), T.StructField("headcount", T.StringType()),
])
#: A posting: one row a job.
POSTING = T.StructType([
    *_struct("source", "company", "category", "job_title", "work_location", "raw_text").fields,
    *(T.StructField(n, _TEXTS) for n in ("responsibilities", "requirements", "preferred", "skills")),
    T.StructField("meta", POSTING_META),
])
#: A posting whose meta holds any keys.
OPEN_POSTING = T.StructType([*POSTING.fields[:-1], T.StructField("meta", T.VariantType())])

#: A file of one company's open positions.
COMPANY_FILE = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("company", _struct("name")),
    T.StructField("positions", T.ArrayType(T.StructType([*_struct("category", "job_title", "work_location", "headcount").fields, *(T.StructField(n, _TEXTS) for n in ("responsibilities", "requirements", "preferred"))]))),
])

#: A job as the postings service returns it.  Category tags are objects or strings, so they stay JSON text.
API_JOB = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("position", T.StringType()),
    T.StructField("due_time", T.StringType()), T.StructField("annual_from", T.IntegerType()), T.StructField("annual_to", T.IntegerType()),
    T.StructField("company", T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])),
    T.StructField("address", _struct("full_location", "country")),
    T.StructField("detail", _struct("intro", "main_tasks", "requirements", "preferred_points")),
    T.StructField("skill_tags", T.ArrayType(_struct("title"))),
    T.StructField("category_tags", T.ArrayType(T.StringType())),
])

#: A résumé's line.
RESUME_FILE = T.StructType([
    *_struct("url", "기업명", "직무", "지원시기").fields,
    T.StructField("합격스펙", _struct("학교", "학과", "학점", "어학점수", "자격증", "대외활동", "대외활동 경력 및 인턴", "경력")),
    T.StructField("자소서", T.ArrayType(_struct("번호", "질문", "답변"))),
    *_struct("id", "title", "crawledAt", "scrapCount", "viewCount", "types").fields,
])

ONTOLOGY = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("released_year", T.IntegerType()), T.StructField("category", T.StringType()),
    T.StructField("versions", T.MapType(T.StringType(), T.IntegerType())), T.StructField("aliases", _TEXTS),
])
#: As a file has it: years may be numbers or strings.
ONTOLOGY_FILE = T.StructType([
    *_struct("name", "released_year", "category").fields, T.StructField("versions", T.MapType(T.StringType(), T.StringType())), T.StructField("aliases", _TEXTS),
])
