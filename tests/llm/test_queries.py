"""Every registered query on the smallest tables: against DuckDB where it has SQL, else its shape."""

import pytest

import __spark_entry__ as E
from claimscope.llm.queries import QUERIES, SQL
from tools.check_oracle import canon, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, con, key):
    df = E.queries()[key](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if key not in SQL:
        table = "conversations" if key == "op8_chat" else "documents"
        if key not in ("op3_decontaminate", "op8_chat"):
            assert len(rows) == con.execute(f"SELECT count(*) FROM {table}").fetchone()[0]
        return
    res = con.execute(SQL[key])
    names = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(names)
    assert canon(rows, df.columns) == canon(res.fetchall(), names)


def test_pipeline_and_oracles_are_registered():
    assert "pipeline" in E.queries()
    assert set(SQL) <= set(E.oracle_sql())
    assert "pipeline" not in E.oracle_sql()
