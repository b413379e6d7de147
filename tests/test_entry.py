"""The driver's contract, and each query against its SQL at the smallest scale."""

import duckdb
import pytest

import __spark_entry__
from jobweave.plans import catalog
from tests.conftest import TESTDATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def rows(frame, columns):
    plain = lambda v: None if v is None or v != v else round(v, 9) if isinstance(v, float) else v.item() if hasattr(v, "item") else v
    return sorted((tuple(plain(v) for v in r) for r in frame[columns].astype(object).values.tolist()), key=str)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    got, expected = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    assert rows(got, columns) == rows(expected, columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["skill", "doc_count"]


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_missing_parts_are_left_out(monkeypatch):
    def absent(name):
        raise ModuleNotFoundError(f"No module named {name}", name="jobweave.llm" if "llm" in name else name)

    monkeypatch.setattr(__spark_entry__.importlib, "import_module", absent)
    assert set(__spark_entry__.queries()) == set(catalog.QUERIES)

    def broken(name):
        raise ModuleNotFoundError("No module named numpy", name="numpy")

    monkeypatch.setattr(__spark_entry__.importlib, "import_module", broken)
    with pytest.raises(ModuleNotFoundError):
        __spark_entry__.queries()
