"""Every registered query against its SQL on a single-node engine."""

import duckdb
import pytest

import __spark_entry__ as driver
import oracle_queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def test_each_query_has_sql():
    assert set(driver.tile_queries()) == set(oracle_queries.build())


@pytest.mark.parametrize("name", sorted(driver.tile_queries()))
def test_query_equals_sql(spark, duck, sf_dir, name):
    frame = driver.queries()[name](spark, sf_dir)
    columns = ", ".join(sorted(frame.columns))
    got = frame.toArrow()
    duck.register("got", got)
    duck.execute(f"CREATE OR REPLACE TEMP TABLE want AS {driver.oracle_sql()[name]}")
    # Same names and types, and the same rows, repeats included.
    described = {
        table: sorted(r[:2] for r in duck.execute(f"DESCRIBE FROM {table}").fetchall())
        for table in ("got", "want")
    }
    assert described["got"] == described["want"]
    assert got.num_rows > 0
    for one, other in (("got", "want"), ("want", "got")):
        extra = duck.execute(
            f"SELECT {columns} FROM {one} EXCEPT ALL SELECT {columns} FROM {other} LIMIT 3"
        ).fetchall()
        assert extra == []


def test_entry(spark):
    ranking = driver.entry(spark)
    assert ranking.count() > 0
    assert ranking.columns[:2] == ["camera_uid", "rank"]
