"""Postings from an HTTP service, as a stream that can be resumed.

The transport, a picklable object, makes the calls, so tests and other services
can bring their own: ``page(job_group, offset, limit) -> list[dict]`` and
``job(id) -> dict``.  Pages are asked for one after the other, up to the first that
fails or is empty, and each is a batch of the stream ``job_page_stream``: its
offset holds the ids found, so no page is asked for twice, however a run ends.

A batch's jobs are fetched by several tasks at one common rate (``pace``), kept
once, and from there written raw, as postings, and as failures with their
reasons, each under ``batch=<number>``.  A batch that is run again replaces its own
files, so that a lost driver leaves whole batches and no line twice.
"""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
import uuid
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from ..operators.shared import folder
from . import schemas
from .files import delete, exists, normalized_jobs
from .pace import Clock, Pace, called


@dataclass
class HttpTransport:
    """GET requests to a JSON service; any failure raises."""

    base: str
    country: str = "kr"
    timeout: float = 20.0
    headers: dict[str, str] = field(default_factory=dict)

    def _get(self, path: str, **query) -> dict:
        url = f"{self.base}{path}" + (f"?{urllib.parse.urlencode(query)}" if query else "")
        with urllib.request.urlopen(urllib.request.Request(url, headers=self.headers), timeout=self.timeout) as reply:
            return json.load(reply)

    def page(self, job_group: int, offset: int, limit: int) -> list[dict]:
        query = {"country": self.country, "job_group_id": job_group, "years": -1, "locations": "all", "job_sort": "job.latest_order"}
        return self._get("/jobs", **query, limit=limit, offset=offset).get("data") or []

    def job(self, job_id: int) -> dict:
        return self._get(f"/jobs/{job_id}").get("job") or {}


def _ids(found: list[dict]) -> list[int]:
    return [item["id"] for item in found if isinstance(item.get("id"), int)]


class PageReader(DataSourceReader):
    """All pages in one partition, since whether a page is asked for depends on the one before."""

    def __init__(self, transport, job_group: int, pages: int, size: int, pause: float, clock: Clock) -> None:
        self.transport, self.job_group, self.pages, self.size, self.pause, self.clock = transport, job_group, pages, size, pause, clock

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for number in range(self.pages):
            if number and self.pause:
                self.clock.sleep(self.pause)
            try:
                found = self.transport.page(self.job_group, number * self.size, self.size)
            except Exception as error:
                yield (number, None, f"{type(error).__name__}: {error}")
                return
            if not found:
                return
            yield from ((number, i, None) for i in _ids(found))


class PageStream(SimpleDataSourceStreamReader):
    """A page a batch.  The offset after a page: the next page's number, and what the page held.

    ended: the page was empty.  error: it failed; a later run asks for it again.
    """

    def __init__(self, transport, job_group: int, pages: int, size: int, pause: float, clock: Clock) -> None:
        self.transport, self.job_group, self.pages, self.size, self.pause, self.clock = transport, job_group, pages, size, pause, clock
        self.asked = 0

    def initialOffset(self) -> dict:
        return {"page": 0, "ids": [], "error": None, "ended": False}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        number = start["page"]
        if start["ended"] or number >= self.pages or (start["error"] and self.asked):
            return iter(()), start
        if self.asked and self.pause:
            self.clock.sleep(self.pause)
        self.asked += 1
        try:
            found = self.transport.page(self.job_group, number * self.size, self.size)
            end = {"page": number + 1, "ids": _ids(found), "error": None, "ended": not found}
        except Exception as error:
            # The count tells one failure from the next, as an offset has to move.
            end = {"page": number, "ids": [], "error": f"{type(error).__name__}: {error}", "ended": False, "failures": start.get("failures", 0) + 1}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        if end["error"]:
            return iter([(end["page"], None, end["error"])])
        return iter([(end["page"] - 1, i, None) for i in end["ids"]])


def page_source(transport, clock: Clock | None = None, stream: bool = False) -> type[DataSource]:
    """A data source over the transport, ``job_pages`` or as a stream ``job_page_stream``; options job_group, pages, page_size and pause."""

    class JobPages(DataSource):
        @classmethod
        def name(cls) -> str:
            return "job_page_stream" if stream else "job_pages"

        def schema(self) -> str:
            return "page int, id long, error string"

        def _reader(self, kind):
            get = lambda key, default: int(self.options.get(key, default))
            return kind(transport, get("job_group", 518), get("pages", 5), get("page_size", 60), float(self.options.get("pause", 0)), clock or Clock())

        def reader(self, schema) -> DataSourceReader:
            return self._reader(PageReader)

        def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
            return self._reader(PageStream)

    return JobPages


def listed(spark: SparkSession, transport, job_group: int = 518, pages: int = 5, page_size: int = 60, pause: float = 0.0) -> DataFrame:
    """page, id, error: all jobs listed before the first page that failed or was empty; one that failed is the last row, without id."""
    spark.dataSource.register(page_source(transport))
    return spark.read.format("job_pages").option("job_group", job_group).option("pages", pages).option("page_size", page_size).option("pause", pause).load()


def listed_stream(spark: SparkSession, transport, job_group: int = 518, pages: int = 5, page_size: int = 60, pause: float = 0.0, clock: Clock | None = None) -> DataFrame:
    """``listed`` as a stream, a page a batch."""
    spark.dataSource.register(page_source(transport, clock, stream=True))
    return spark.readStream.format("job_page_stream").option("job_group", job_group).option("pages", pages).option("page_size", page_size).option("pause", pause).load()


def unseen(ids: DataFrame, seen: DataFrame) -> DataFrame:
    """The rows of ids whose id isn't among those seen."""
    return ids.join(seen.select("id"), "id", "left_anti")


def seen_ids(spark: SparkSession, path: str, but: int | None = None) -> DataFrame:
    """Ids of the postings already stored, those of batch ``but`` aside; malformed lines are skipped, a missing id counts as -1."""
    if not exists(spark, path):
        return spark.createDataFrame([], "id long")
    rows = spark.read.schema("meta variant, batch int").json(path, mode="DROPMALFORMED")
    if but is not None:
        rows = rows.where(F.col("batch").isNull() | (F.col("batch") != but))
    return rows.select(F.coalesce(F.try_variant_get("meta", "$.id", "long"), F.lit(-1)).alias("id")).distinct()


def _fetch(batches: Iterator[pa.RecordBatch], transport, pace: Pace, attempts: int) -> Iterator[pa.RecordBatch]:
    last: dict[int, int | None] = {}
    for batch in batches:
        rows = []
        for job_id, lane in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            job, error, made, last[lane] = called(partial(transport.job, job_id), pace, lane, last.get(lane), attempts)
            rows.append((job_id, json.dumps(job, ensure_ascii=False) if job else None, error if error or job else "empty", made))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.int32()), strict=True)] if rows else [pa.array([], t) for t in (pa.int64(), pa.string(), pa.string(), pa.int32())], ["id", "job", "error", "attempts"])


def fetched(ids: DataFrame, transport, sleep: float = 1.0, lanes: int | None = None, attempts: int = 1, clock: Clock | None = None) -> DataFrame:
    """id, job (JSON text), error, attempts: each id's job, or why there is none.

    At most one call begins each ``sleep`` seconds, over all tasks together;
    a call that fails is made again at its lane's next turn, up to ``attempts``.
    """
    lanes = lanes or ids.sparkSession.sparkContext.defaultParallelism
    clock = clock or Clock()
    pace = Pace(sleep, lanes, clock.now(), clock)
    dealt = ids.select("id", F.pmod(F.xxhash64("id"), F.lit(lanes)).cast("int").alias("lane")).repartitionById(lanes, F.col("lane"))
    return dealt.mapInArrow(partial(_fetch, transport=transport, pace=pace, attempts=attempts), "id long, job string, error string, attempts int")


def _store(batch: DataFrame, number: int, transport, out: str, raw: str, failures: str, state: str, fetch: dict) -> None:
    """One page's jobs, from fetching to files.  Run again, it fetches nothing that is kept and replaces its own files."""
    spark = batch.sparkSession
    part = f"batch={number}"
    kept = f"{state}/fetched/{part}"
    if not exists(spark, f"{kept}/_SUCCESS"):
        ids = unseen(batch.where("id is not null").select("id"), seen_ids(spark, out, number))
        pages = batch.where("error is not null").select("page", F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("job"), "error", F.lit(1).alias("attempts"))
        jobs = fetched(ids, transport, **fetch).select(F.lit(None).cast("int").alias("page"), "id", "job", "error", "attempts")
        pages.unionByName(jobs).write.mode("overwrite").parquet(kept)
    rows = spark.read.schema("page int, id long, job string, error string, attempts int").parquet(kept)
    done = rows.where("job is not null").select("job")
    failed = rows.where("job is null").select("page", "id", "error", "attempts")
    if not failed.isEmpty():
        failed.write.mode("overwrite").json(f"{failures}/{part}")
    if not done.isEmpty():
        done.write.mode("overwrite").text(f"{raw}/{part}")
        normalized_jobs(done.select(F.from_json("job", schemas.API_JOB).alias("j")).select("j.*")).write.mode("overwrite").json(f"{out}/{part}")


FAILURES = "page int, id long, error string, attempts int"


def failed(spark: SparkSession, path: str) -> DataFrame:
    """page, id, error, attempts: the pages and jobs that a crawl could not get."""
    if not exists(spark, path):
        return spark.createDataFrame([], FAILURES)
    return spark.read.schema(FAILURES).json(path).select("page", "id", "error", "attempts")


def crawl(
    spark: SparkSession, transport, out_path: str, raw_path: str, job_group: int = 518, pages: int = 5, page_size: int = 60, sleep: float = 1.0, resume: bool = False,
    state: str | None = None, lanes: int | None = None, attempts: int = 1, failures: str | None = None, clock: Clock | None = None,
) -> None:
    """Fetch listed jobs that aren't stored yet; write them raw, as postings, and what failed.

    With ``state``, a folder, a crawl that was broken off goes on where it stood;
    a new one begins with a new folder.  Without ``resume`` a new crawl replaces
    what is stored.  Jobs that a page lists twice are stored twice, those of an
    earlier page are not fetched again.  A page that fails ends the crawl with a
    warning.  ``sleep`` is the pause between calls, of pages as of jobs.
    """
    failures = failures or f"{out_path}.failures"
    begun, own = state is not None and exists(spark, state), state is None
    state = state or f"{folder(spark)}/crawl-{uuid.uuid4().hex}"
    if not resume and not begun:
        for path in (out_path, raw_path, failures):
            delete(spark, path)
    fetch = {"sleep": sleep, "lanes": lanes, "attempts": attempts, "clock": clock}
    numbered = {}

    def store(batch: DataFrame, number: int) -> None:
        # Batches count on from those that other crawls have stored.
        if "first" not in numbered:
            numbered["first"] = _first_batch(spark, state, (out_path, raw_path, failures))
        at = numbered["last"] = numbered["first"] + number
        _store(batch, at, transport, out_path, raw_path, failures, state, fetch)
        for row in batch.where("error is not null").select("page", "error").collect():  # one row at most
            warnings.warn(f"page {row.page} failed, the crawl ends there: {row.error}", stacklevel=2)

    rows = listed_stream(spark, transport, job_group, pages, page_size, sleep, clock)
    query = rows.writeStream.foreachBatch(store).option("checkpointLocation", f"{state}/checkpoint").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
        if own:
            delete(spark, state)


def _first_batch(spark: SparkSession, state: str, paths: tuple[str, ...]) -> int:
    """The number of a crawl's first batch, kept with its state: above all that are stored already."""
    path = f"{state}/first"
    if not exists(spark, f"{path}/_SUCCESS"):
        stored = [_last_batch(spark, p) for p in paths]
        spark.range(1).select((F.lit(max(stored)) + 1).alias("first")).write.mode("overwrite").json(path)
    return spark.read.schema("first long").json(path).first().first


def _last_batch(spark: SparkSession, path: str) -> int:
    """The highest batch number among a folder's parts, -1 if there is none."""
    if not exists(spark, path):
        return -1
    jvm = spark._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath().getName() for f in there.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(there)]
    return max((int(n.partition("=")[2]) for n in names if n.startswith("batch=")), default=-1)
