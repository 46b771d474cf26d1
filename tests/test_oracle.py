"""Every catalogued query against its DuckDB oracle on the smallest fixture."""

import pytest

import __spark_entry__ as E
from tools.check_oracle import canon, duck

SF = "/root/testdata/sf0.001"
QUERIES = E.queries()
SQLS = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, con, key):
    df = QUERIES[key](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if key not in SQLS:
        assert df.columns  # rows-only: it runs and has a schema
        return
    res = con.execute(SQLS[key])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    drows = res.fetchall()
    assert len(rows) == len(drows)
    assert canon(rows, df.columns) == canon(drows, dcols)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["risk_tier", "claims", "avg_score", "exposure_M"]
    assert df.count() >= 1


def test_oracle_contract(con):
    # every oracle belongs to a registered query, and every oracle plans in DuckDB
    assert set(SQLS) <= set(QUERIES)
    for key, sql in SQLS.items():
        con.execute("EXPLAIN " + sql)
