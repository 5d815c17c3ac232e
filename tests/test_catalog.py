"""Every query with a DuckDB twin gives the twin's rows on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from wayfold.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(rows):
    one = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(map(one, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_twin(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    twin = duck.sql(catalog.ORACLE_SQL[name])
    assert columns == sorted(twin.columns)
    pick = ", ".join(f'"{c}"' for c in columns)
    assert plain(df.select(*columns).collect()) == plain(duck.sql(f"SELECT {pick} FROM ({catalog.ORACLE_SQL[name]})").fetchall())


def test_every_query_has_a_twin():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and list(rows[0].asDict()) == ["id", "label", "meters", "distance"]
    assert [r.meters for r in rows] == sorted(r.meters for r in rows)
    assert set(entry.oracle_sql()) <= set(entry.queries())
