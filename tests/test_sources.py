"""Readers, writers, the crawl, the stream and the command line."""

import json
import time

import pytest
from pyspark.sql import functions as F

from jobweave.__main__ import main
from jobweave.sources import crawl, files, pace, schemas
from jobweave.sources.config import Config
from jobweave.streaming import skills as stream


def lines(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows) + "\n")
    return str(path)


def test_company_file(spark, tmp_path):
    path = tmp_path / "c.json"
    position = {"category": None, "job_title": "Dev", "work_location": "Seoul", "headcount": "2", "responsibilities": ["a"], "requirements": None, "preferred": ["b", "c"]}
    path.write_text(json.dumps({"url": "u", "company": {"name": "Co"}, "skills": ["x"], "positions": [position, {"job_title": "Ops"}]}))
    rows = {r.job_title: r for r in files.company_positions(spark, str(path)).collect()}
    assert rows["Dev"].raw_text == "Dev\na\nb\nc" and rows["Dev"].skills == [] and rows["Dev"].category is None and rows["Dev"].meta.headcount == "2" and rows["Dev"].meta.url == "u"
    assert rows["Ops"].requirements == [] and rows["Ops"].company == "Co" and rows["Ops"].source == "jobkorea"
    path.write_text(json.dumps({"url": "u", "positions": []}))
    assert files.company_positions(spark, str(path)).count() == 0
    with pytest.raises(Exception, match="(?i)path"):
        files.company_positions(spark, str(tmp_path / "none")).count()


def test_posting_lines(spark, tmp_path):
    path = lines(tmp_path / "p.jsonl", [{"company": None, "skills": ["a"], "meta": {"id": 3}}, "", {"source": "s", "raw_text": "t"}])
    rows = sorted(files.posting_lines(spark, path).collect(), key=lambda r: r.source)
    assert [(r.source, r.company, r.skills, r.raw_text) for r in rows] == [("s", "", [], "t"), ("wanted", "", ["a"], "")]
    assert files.posting_lines(spark, str(tmp_path / "none")).count() == 0
    assert files.postings(spark, str(tmp_path / "none"), path).count() == 2
    bad = lines(tmp_path / "bad.jsonl", [{"company": "x"}, "{oops"])
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        files.posting_lines(spark, bad).collect()


def test_resumes(spark, tmp_path):
    spec = {"학교": "S", "대외활동": "", "대외활동 경력 및 인턴": "I", "자격증": "Python cert"}
    rows = [
        {"url": "1", "기업명": "C", "합격스펙": spec, "자소서": [{"번호": 0, "질문": "Q", "답변": "A"}, {"번호": "2", "질문": None, "답변": "B"}]},
        {"url": "2", "자소서": []},
        {"url": "3"},
    ]
    path = lines(tmp_path / "r.jsonl", rows)
    found = files.resumes(spark, path, str(tmp_path / "none"))
    (row,) = found.collect()
    assert (row.source, row.pass_spec.activities, row.pass_spec.gpa, row.sections[0].number) == ("linkareer", "I", "", "")
    assert found.select(files.full_text(F.col("sections"))).first()[0] == "[] Q\nA\n\n[2] \nB"
    assert files.index_text(found).first().text.endswith("B Python cert")
    assert files.resumes(spark, path, path, 0).count() == 0 and files.resumes(spark, path, path).count() == 2


class Fake:
    """A service of three pages; the third fails."""

    def page(self, job_group, offset, limit):
        number = offset // limit
        if number == 2:
            raise OSError("down")
        return [{"id": 10 * number + i} for i in range(2)] + [{"id": "x"}] if number < 2 else []

    def job(self, job_id):
        if job_id == 1:
            raise OSError("no")
        if job_id == 10:
            return {}
        return {"id": job_id, "position": "P", "company": {"id": 5, "name": "Co"}, "address": {"full_location": "", "country": "KR"}, "detail": {"intro": " hi ", "main_tasks": "- a\n• b", "requirements": None}, "skill_tags": [{"title": "Go"}, {"title": ""}, None], "category_tags": [{"title": "Dev"}, "Ops", None]}


def test_crawl(spark, tmp_path):
    out, raw = str(tmp_path / "out"), str(tmp_path / "raw")
    run = lambda resume: crawl.crawl(spark, Fake(), out, raw, pages=4, page_size=2, sleep=0, resume=resume)
    run(False)
    rows = files.posting_lines(spark, out).orderBy("meta.id").collect()
    assert [r.meta.id for r in rows] == [0, 11] and rows[0].category == "Dev,Ops" and rows[0].skills == ["Go"] and rows[0].work_location == "KR"
    assert rows[0].raw_text == "P\nhi\n- a\n• b\n\n" and rows[0].responsibilities == ["a", "b"] and rows[0].meta.url.endswith("/0")
    run(True)  # all are stored already
    assert files.posting_lines(spark, out).count() == 2 and spark.read.text(raw).count() == 2
    assert crawl.seen_ids(spark, str(tmp_path / "none")).count() == 0


class Counting(Fake):
    """Writes down each page that is asked for; the second is empty."""

    def __init__(self, path):
        self.path = path

    def page(self, job_group, offset, limit):
        with open(self.path, "a") as f:
            f.write(f"{offset // limit}\n")
        if offset // limit == 1:
            raise OSError("down")
        return [{"id": 1}]


def test_each_page_once_and_none_after_a_failure(spark, tmp_path):
    log = tmp_path / "pages"
    with pytest.warns(UserWarning, match="page 1 failed.*down"):
        crawl.crawl(spark, Counting(str(log)), str(tmp_path / "o"), str(tmp_path / "r"), pages=5, page_size=1, sleep=0)
    assert log.read_text().split() == ["0", "1"]


class Logged:
    """Three pages of four jobs; writes down each call.  Job 6 breaks the task until the flag is there; job 9 fails once, 10 always."""

    def __init__(self, folder):
        self.folder = folder

    def _log(self, call):
        with open(f"{self.folder}/calls", "a") as f:
            f.write(f"{call}\n")

    def page(self, job_group, offset, limit):
        self._log(f"page {offset // limit}")
        return [{"id": offset + i} for i in range(4)] if offset < 12 else []

    def job(self, job_id):
        import os

        self._log(f"job {job_id}")
        if job_id == 6 and not os.path.exists(f"{self.folder}/flag"):
            raise SystemExit("the executor is gone")
        with open(f"{self.folder}/calls") as f:
            tried = f.read().split("\n").count(f"job {job_id}")
        if job_id == 10 or job_id == 9 and tried == 1:
            raise OSError("no answer")
        return {"id": job_id, "position": f"P{job_id}"}


def test_a_broken_crawl_goes_on(spark, tmp_path):
    """No page is asked for twice, no job of a stored page either; files agree and hold no line twice."""
    out, raw, state = (str(tmp_path / n) for n in ("out", "raw", "state"))
    run = lambda **more: crawl.crawl(spark, Logged(str(tmp_path)), out, raw, pages=9, page_size=4, sleep=0, state=state, lanes=1, attempts=2, **more)
    with pytest.raises(Exception, match="(?s)."):
        run()
    ids = lambda path, column: sorted(r[0] for r in spark.read.json(path).select(column).collect())
    assert ids(out, "meta.id") == ids(raw, "id") == [0, 1, 2, 3]
    (tmp_path / "flag").touch()
    run()
    calls = (tmp_path / "calls").read_text().split("\n")
    assert [c for c in calls if c.startswith("page")] == [f"page {i}" for i in range(4)]
    assert all(calls.count(f"job {i}") == 1 for i in (0, 1, 2, 3, 7, 8, 11)) and calls.count("job 9") == calls.count("job 10") == 2
    assert ids(out, "meta.id") == ids(raw, "id") == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 11]
    assert [tuple(r) for r in crawl.failed(spark, f"{out}.failures").collect()] == [(None, 10, "OSError: no answer", 2)]
    run()  # nothing is left to do
    assert (tmp_path / "calls").read_text().split("\n") == calls
    crawl.crawl(spark, Logged(str(tmp_path)), out, raw, pages=9, page_size=4, sleep=0, resume=True, lanes=2)
    again = (tmp_path / "calls").read_text().split("\n")[len(calls) - 1 :]
    assert [c for c in again if c.startswith("job")] == ["job 10"] and ids(out, "meta.id") == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 11]


def test_a_kept_batch_is_not_fetched_again(spark, tmp_path):
    """A driver lost between fetching and writing: run again, the batch makes no call."""
    out, raw, state, failures = (str(tmp_path / n) for n in ("out", "raw", "state", "failures"))
    batch = spark.createDataFrame([(0, 1, None), (0, 2, None), (1, None, "down")], "page int, id long, error string")
    store = lambda transport: crawl._store(batch, 3, transport, out, raw, failures, state, {"sleep": 0, "lanes": 1})
    store(Logged(str(tmp_path)))
    before = sorted(r.value for r in spark.read.text(raw).select("value").collect())
    crawl.delete(spark, raw)
    store(None)  # a transport that would fail
    assert sorted(r.value for r in spark.read.text(raw).select("value").collect()) == before and len(before) == 2
    assert [tuple(r) for r in crawl.failed(spark, failures).collect()] == [(1, None, "down", 1)]


class Ticks(pace.Clock):
    def __init__(self, at):
        self.at = at

    def now(self):
        return self.at

    def sleep(self, seconds):
        self.at += seconds


def test_one_rate_for_all_lanes():
    """Four lanes, some late and with slow calls, one that tries again: never two calls within a turn."""
    calls = []
    for lane, late, slow in ((0, 0, 0), (1, 7.3, 0.4), (2, 0, 5.7), (3, 2, 0)):
        clock, last = Ticks(100.0 + late), None
        shared = pace.Pace(1.0, 4, 100.0, clock)

        def call(clock=clock, slow=slow, lane=lane):
            calls.append(clock.now())
            clock.sleep(slow)
            if lane == 3:
                raise OSError
            return {}

        for _ in range(20):
            *_, made, last = pace.called(call, shared, lane, last, attempts=3)
            assert made == (3 if lane == 3 else 1)
    calls.sort()
    assert len(calls) == 3 * 20 + 60 and min(b - a for a, b in zip(calls, calls[1:], strict=False)) > 1 - 1e-6


def test_pause_between_pages():
    clock = Ticks(0.0)

    class Times:
        def page(self, job_group, offset, limit):
            seen.append(clock.now())
            return [{"id": offset}]

    seen = []
    stream = crawl.PageStream(Times(), 1, 3, 1, 2.0, clock)
    offset = stream.initialOffset()
    for _ in range(5):
        _, offset = stream.read(offset)
    assert seen == [0.0, 2.0, 4.0] and offset["page"] == 3
    assert list(crawl.PageReader(Times(), 1, 3, 1, 2.0, clock).read(None)) == [(0, 0, None), (1, 1, None), (2, 2, None)] and seen[3:] == [4.0, 6.0, 8.0]


def test_open_meta(spark, tmp_path):
    """Keys that no schema knows survive reading and writing."""
    meta = {"id": 3, "tags": ["a", {"b": 1.5}], "crawledAt": "t", "none": None}
    path = lines(tmp_path / "p.jsonl", [{"raw_text": "t", "meta": meta}, {"raw_text": "u"}])
    files.write_lines(files.posting_lines(spark, path, open_meta=True), str(tmp_path / "out"))
    back = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert [r.get("meta") for r in sorted(back, key=lambda r: r["raw_text"])] == [meta, None]
    assert sorted(r.id for r in crawl.seen_ids(spark, str(tmp_path / "out")).collect()) == [-1, 3]
    company = tmp_path / "c.json"
    company.write_text(json.dumps({"url": "u", "company": {"name": "Co"}, "positions": [{"job_title": "Dev", "headcount": "2"}]}))
    rows = files.postings(spark, str(company), path, open_meta=True)
    got = [json.loads(r[0]) if r[0] else None for r in rows.select(F.to_json("meta")).collect()]
    assert sorted(got, key=lambda m: len(m or "")) == [None, {"headcount": "2", "url": "u"}, meta]


def test_category_rules(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps([{"category": "X", "patterns": ["dev", "개발"]}, {"category": "Y", "patterns": ["it"]}]), encoding="utf-8")
    rules = files.category_rules(spark, str(path))
    assert rules == [("X", ["dev", "개발"]), ("Y", ["it"])]

    from jobweave.functions.text import normalize_category

    rows = spark.createDataFrame([("웹개발자",), ("IT 지원",), ("visit",), (None,)], "t string")
    assert [r[0] for r in rows.select(normalize_category(F.col("t"), rules)).collect()] == ["X", "Y", "기타", "미분류"]
    path.write_text("[{", encoding="utf-8")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        files.category_rules(spark, str(path))


def test_ontology_file_years_and_errors(spark, tmp_path):
    from jobweave.operators import ontology

    path = tmp_path / "o.json"
    path.write_text(json.dumps([{"name": "A", "released_year": "2013", "versions": {"2": "2015", "3": 2016}}, {"name": "a", "released_year": 2014}]))
    known = ontology.load(spark, str(path))
    assert [(t.released_year, t.versions) for t in known] == [(2013, {"2": 2015, "3": 2016}), (2014, {})]
    assert ontology.unique_names(ontology.read(spark, str(path))).first().n == 1
    for broken in ("[{", '[{"name": "A", "released_year": "soon"}]'):
        path.write_text(broken)
        with pytest.raises(Exception, match="(?i)malformed|parse|no year"):
            ontology.load(spark, str(path))


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines(tmp_path / "in" / "a.jsonl", [{"raw_text": "Python and Docker", "skills": ["K8S"]}])
    rows = stream.with_skills(stream.posting_stream(spark, str(tmp_path / "in")))
    query = stream.append(rows, str(tmp_path / "out"), str(tmp_path / "state"))
    began = time.time()
    while query.isActive and time.time() - began < 60:
        time.sleep(0.2)
    assert spark.read.parquet(str(tmp_path / "out")).first()["items"] == ["docker", "kubernetes", "python"]


def test_config():
    assert Config.load({}).ontology_path == "data/ontology.json"
    assert Config.load({"JOBWEAVE_ONTOLOGY_PATH": "x"}).ontology_path == "x"


def scorer_of(model):
    """A factory as settings name it; the score of a sentence is the model's name's length."""
    return lambda: lambda batch: [float(len(model)) for _ in batch]


def test_plugins():
    config = Config.load({"JOBWEAVE_SCORER": "tests.test_sources:scorer_of", "JOBWEAVE_PERPLEXITY_MODEL": "four"})
    assert config.plugin("scorer", config.perplexity_model)()(["a", "b"]) == [4.0, 4.0]
    assert Config.load({}).plugin("scorer", "x") is None
    with pytest.raises(ValueError, match="module:name"):
        Config.load({"JOBWEAVE_SCORER": "no colon"}).plugin("scorer", "x")


def test_demo_with_a_scorer(spark, tmp_path, capsys, monkeypatch):
    ontology = tmp_path / "o.json"
    ontology.write_text("[]")
    assert main(["demo", "--module", "audit", "--ontology", str(ontology), "--use-ml", "--scorer", "tests.test_sources:scorer_of"]) == 0
    assert "ai_probability" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["demo", "--module", "audit", "--ontology", str(ontology), "--use-ml"])


def test_command_line(spark, tmp_path, capsys):
    path = lines(tmp_path / "p.jsonl", [{"raw_text": "Python Docker AWS"}] * 3)
    assert main(["mine", "--postings", path, "--company", str(tmp_path / "none")]) == 0
    assert "docker" in capsys.readouterr().out
    ontology = tmp_path / "o.json"
    ontology.write_text(json.dumps([{"name": "Docker", "released_year": 2013, "category": "c", "versions": {}, "aliases": []}]))
    assert main(["validate", "--ontology", str(ontology)]) == 0
    assert main(["demo", "--ontology", str(ontology)]) == 0
    resumes = lines(tmp_path / "r.jsonl", [{"url": "1", "자소서": [{"번호": "1", "질문": "Q", "답변": "2010년에 Docker로"}]}])
    assert main(["audit", "--ontology", str(ontology), "--linkareer", resumes, "--cafe", str(tmp_path / "none")]) == 0
    assert "release_year" in capsys.readouterr().out


def test_schemas_are_stable():
    assert [f.name for f in schemas.ONTOLOGY] == ["name", "released_year", "category", "versions", "aliases"]
