"""Every registered query with SQL, on the smallest tables, against DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as e
from seine.plans import queries as q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(p := f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return con


def plain(rows):
    return sorted((tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(q.SQL))
def test_against_sql(name, spark, sf, db):
    got = e.queries()[name](spark, sf)
    cols = sorted(got.columns)
    want = db.sql(e.oracle_sql()[name])
    assert sorted(want.columns) == cols
    assert plain(map(tuple, got.select(*cols).collect())) == plain(want.select(", ".join(cols)).fetchall())


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.SQL)))
def test_runs(name, spark, sf):
    q.QUERIES[name](spark, sf).count()


def test_entry(spark):
    assert e.entry(spark).columns == ["doc_id", "score"]
