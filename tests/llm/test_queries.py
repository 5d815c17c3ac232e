"""Every training-data query with a DuckDB twin gives the twin's rows on the smallest tables."""

import math

import duckdb
import pytest

from wayfold.llm import queries

FOLDER = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(rows):
    one = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(map(one, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_twin(spark, duck, name):
    df = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    pick = ", ".join(f'"{c}"' for c in columns)
    twin = duck.sql(f"SELECT {pick} FROM ({queries.ORACLE_SQL[name]})")
    assert columns == sorted(duck.sql(queries.ORACLE_SQL[name]).columns)
    assert plain(df.select(*columns).collect()) == plain(twin.fetchall())


def test_calls_are_linked_moved_and_circular(spark):
    """The rows that op10 is compared on hold every case of its method."""
    df = queries.op10_chat(spark, FOLDER)
    row = df.selectExpr("count_if(linked)", "count_if(depth > 1)", "count_if(cyclic)", "count_if(n_valid < n_calls)", "count_if(role = 'tool' and not linked)").first()
    assert all(n > 0 for n in row)
