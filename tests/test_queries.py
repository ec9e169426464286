"""Registered queries against DuckDB on the smallest tables, and the registry itself."""

import os

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data here")


def same(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return round(float(value), 6)
    return str(value)


def listed(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(same(r[i]) for i in order) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck():
    made = duckdb.connect()
    for file in os.listdir(FOLDER):
        made.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    return made


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if not n.startswith(("op", "pipeline"))])
def test_query_equals_oracle(spark, duck, name):
    expected = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in expected.description]
    found = entry.queries()[name](spark, FOLDER)
    assert sorted(found.columns) == sorted(names)
    assert listed([tuple(r) for r in found.collect()], found.columns) == listed(expected.fetchall(), names)


@pytest.mark.parametrize("name", ["row_number", "rank_window", "dense_rank_window", "window_multi_partition", "window_nulls", "window_over_agg", "external_sort"])
def test_query_equals_oracle_where_rows_are_dealt_by_range(spark, duck, monkeypatch, name):
    from tarn.plans import ranges

    monkeypatch.setattr(ranges, "MOST", 4)
    monkeypatch.setattr(ranges, "tasks", lambda df, total: 7)
    test_query_equals_oracle(spark, duck, name)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
