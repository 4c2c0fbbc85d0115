"""Registered queries of the subpackage against their SQL on a single-node engine."""

import duckdb
import pytest

from tilerank.llm import queries as registered

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_query_equals_sql(spark, duck, sf_dir, name):
    frame = registered.queries()[name](spark, sf_dir)
    columns = ", ".join(sorted(frame.columns))
    duck.register("got", frame.toArrow())
    duck.execute(f"CREATE OR REPLACE TEMP TABLE want AS {registered.oracle_sql()[name]}")
    described = {
        table: sorted(r[:2] for r in duck.execute(f"DESCRIBE FROM {table}").fetchall())
        for table in ("got", "want")
    }
    assert described["got"] == described["want"]
    for one, other in (("got", "want"), ("want", "got")):
        extra = duck.execute(
            f"SELECT {columns} FROM {one} EXCEPT ALL SELECT {columns} FROM {other} LIMIT 3"
        ).fetchall()
        assert extra == []
