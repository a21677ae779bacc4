"""Every catalogued query against its DuckDB oracle (and rows-only ones run)."""

import duckdb
import pytest

import __spark_entry__ as E
from tools.oracle_check import key, norm
from quarry.sources.tables import TABLES, table_path

SF = "/root/testdata/sf0.001"
NAMES = sorted(E.queries())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF, t)}')")
    return c


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["id", "repository", "context", "filepath", "score"]
    assert df.count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    cols = df.columns
    rows = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
    sql = E.oracle_sql().get(name)
    if sql is None:
        return
    cur = con.execute(sql)
    dcols = [x[0] for x in cur.description]
    assert sorted(cols) == sorted(dcols)
    order = [dcols.index(c) for c in cols]
    drows = [tuple(norm(r[i]) for i in order) for r in cur.fetchall()]
    assert sorted(rows, key=key) == sorted(drows, key=key)
