"""Each catalogue query against its SQL in DuckDB, on the driver's smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from loomdex.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(names, values):
    return sorted(repr([v[c] for c in sorted(names)]) for v in values)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    expected = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(expected.columns)
    wanted = [dict(zip(expected.columns, r, strict=True)) for r in expected.fetchall()]
    found = [r.asDict(recursive=True) for r in got.collect()]
    assert rows(got.columns, found) == rows(got.columns, wanted)
    assert found or name in ("chunk_diff",)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_stream_equals_batch(spark):
    stream = catalog.QUERIES["stream_dirty"](spark, SF)
    batch = catalog.QUERIES["dirty_files"](spark, SF)
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, batch.collect()))


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["project_id", "received", "hits", "needed", "vectorized"]
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
