"""Every registered query against its reference SQL, and the driver contract."""

import importlib.util
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

spec = importlib.util.spec_from_file_location("check_queries", Path(__file__).resolve().parent.parent / "tools" / "check_queries.py")
check = importlib.util.module_from_spec(spec)
spec.loader.exec_module(check)

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db(data):
    connection = duckdb.connect()
    for path in sorted(Path(data).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_reference_sql(spark, db, data, name):
    verdict = check.compare(QUERIES[name](spark, data), db.execute(ORACLE[name]))
    assert verdict.startswith("ok"), verdict


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_model_queries_return_rows(spark, data, name):
    assert QUERIES[name](spark, data).limit(1).collect()


def test_entry_point(spark, monkeypatch, data):
    assert entry.entry(spark).columns[0] == "category"
    assert set(ORACLE) < set(QUERIES)
