"""Every registered query at the smallest scale, against its SQL on another engine.

No plan may pair everything with everything.
"""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF, plan_of
from verify import TABLES, rows_of

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    plan = plan_of(df)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    got = [tuple(r) for r in df.collect()]
    assert len(set(df.columns)) == len(df.columns)
    if name not in ORACLES:
        assert got
        return
    cur = db.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, got) == rows_of(names, cur.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["tag", "n", "translated", "common"]
    assert df.count() > 0
