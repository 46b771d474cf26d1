"""Physical-plan checks: pushdown, no Python UDFs, shuffle structure."""

import pytest

from claimscope.operators.gold import gold_score
from claimscope.operators.silver import claim_velocity
from claimscope.plans import layers as L
from claimscope.sources.tables import read_table

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_pushdown_and_pruning(spark):
    from pyspark.sql import functions as F

    df = read_table(spark, SF, "customer").filter(F.col("c_acctbal") >= 1000).select("c_custkey", "c_acctbal")
    p = plan(df)
    assert "PushedFilters: [IsNotNull(c_acctbal), GreaterThanOrEqual(c_acctbal,1000.0)]" in p
    assert "ReadSchema: struct<c_custkey:bigint,c_acctbal:double>" in p


@pytest.mark.parametrize("key", ["tier_summary", "gold_score", "audit_row", "synthesis_parse", "dq_report"])
def test_no_python_udf(spark, key):
    import __spark_entry__ as E

    p = plan(E.queries()[key](spark, SF))
    for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas"):
        assert node not in p


def test_gold_scoring_adds_no_exchange(spark):
    silver = L.silver(spark, SF)
    before = plan(silver).count("Exchange")
    after = plan(gold_score(silver)).count("Exchange")
    assert after == before


def test_daily_velocity_windows_daily_counts_not_claims(spark):
    claims = L.bronze_claims(spark, SF)
    p = claims.transform(lambda d: claim_velocity(d, strategy="daily"))._jdf.queryExecution().optimizedPlan().toString()
    # the window's input is the (claimant, day) aggregate
    window_at = p.index("Window [")
    assert "Aggregate [claimant_id" in p[window_at:]


def test_replies_never_broadcast_in_bulk_parse(spark):
    import __spark_entry__ as E

    p = plan(E.queries()["synthesis_parse"](spark, SF))
    assert "SortMergeJoin" in p
