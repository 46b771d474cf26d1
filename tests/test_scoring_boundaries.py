"""Boundary and null-branch tests of silver features and gold scoring."""

import datetime as dt

import pytest

from claimscope import constants as K
from claimscope.operators.gold import gold_score, score_claims, tier_summary
from claimscope.operators.silver import claim_velocity, claim_velocity_as_written, silver_enrich

AS_OF = dt.date(2024, 6, 30)
CLAIM_SCHEMA = (
    "claim_id string, claimant_id string, property_id string, claim_type string, fraud_label string, "
    "is_confirmed_fraud boolean, claim_amount double, claim_status string, filed_date date, resolved_date date, "
    "assigned_investigator string, state string, id_verified boolean, value_pct_change double, has_lien boolean, "
    "account_age_days bigint"
)


def claim(i, claimant="C1", filed=AS_OF, amount=1000.0, pct=0.0, verified=True, lien=False, age=4000):
    return (f"CLM-2024-{i}", claimant, f"PROP-{i}", "LIEN", "NONE", False, amount, "OPEN", filed, None,
            "J.Rivera", "TX", verified, pct, lien, age)


def silver_of(spark, rows, **kw):
    return silver_enrich(spark.createDataFrame(rows, CLAIM_SCHEMA), as_of=AS_OF, **kw)


def test_recency_bucket_bounds(spark):
    days = [0, 30, 31, 90, 91, 365, 366, -5]
    rows = [claim(i, claimant=f"C{i}", filed=AS_OF - dt.timedelta(days=d)) for i, d in enumerate(days)]
    out = {r.claim_id: (r.days_since_filed, r.recency_bucket) for r in silver_of(spark, rows).collect()}
    got = [out[f"CLM-2024-{i}"] for i in range(len(days))]
    assert got == [(0, "LAST_30D"), (30, "LAST_30D"), (31, "LAST_90D"), (90, "LAST_90D"), (91, "LAST_YEAR"),
                   (365, "LAST_YEAR"), (366, "OLDER"), (-5, "LAST_30D")]


def test_null_filed_date_is_older(spark):
    out = silver_of(spark, [claim(1, filed=None)]).collect()[0]
    assert out.days_since_filed is None and out.recency_bucket == "OLDER"


@pytest.mark.parametrize("strategy", ["daily", "window"])
def test_velocity_window_day_720_and_721(spark, strategy):
    base = AS_OF
    rows = [
        claim(1, filed=base - dt.timedelta(days=720)),
        claim(2, filed=base - dt.timedelta(days=721)),
        claim(3, filed=base),
        claim(4, filed=base),            # same-day peer
        claim(5, claimant="C2", filed=base),
    ]
    df = spark.createDataFrame(rows, CLAIM_SCHEMA)
    got = {r.claim_id: r.claim_velocity_24mo for r in claim_velocity(df, strategy=strategy).collect()}
    # claim 3/4: themselves + each other + the claim 720 days back (721 is outside)
    assert got == {"CLM-2024-1": 2, "CLM-2024-2": 1, "CLM-2024-3": 3, "CLM-2024-4": 3, "CLM-2024-5": 1}


def test_velocity_strategies_agree_with_nulls(spark):
    rows = [claim(1, filed=None), claim(2, filed=None), claim(3), claim(4, claimant=None), claim(5, claimant=None)]
    df = spark.createDataFrame(rows, CLAIM_SCHEMA)
    a = sorted((r.claim_id, r.claim_velocity_24mo) for r in claim_velocity(df, strategy="daily").collect())
    b = sorted((r.claim_id, r.claim_velocity_24mo) for r in claim_velocity(df, strategy="window").collect())
    assert a == b


def test_velocity_as_written_is_total_per_claimant(spark):
    rows = [claim(i, filed=AS_OF - dt.timedelta(days=400 * i)) for i in range(4)]
    got = {r.claim_velocity_24mo for r in claim_velocity_as_written(spark.createDataFrame(rows, CLAIM_SCHEMA)).collect()}
    assert got == {4}


@pytest.mark.parametrize(
    "pct,spike",
    [(20.0, 0.0), (20.01, 0.65), (40.0, 0.65), (40.01, 1.0), (None, 0.0)],
)
def test_property_spike_levels(spark, pct, spike):
    row = score_claims(silver_of(spark, [claim(1, pct=pct)])).collect()[0]
    assert row.sig_property_spike == spike
    assert row.property_spike is (None if pct is None else pct > 20)


@pytest.mark.parametrize(
    "amount,level", [(100000.0, 0.0), (100000.01, 0.55), (250000.0, 0.55), (250000.01, 1.0)]
)
def test_high_value_levels(spark, amount, level):
    assert score_claims(silver_of(spark, [claim(1, amount=amount)])).collect()[0].sig_high_value == level


@pytest.mark.parametrize("age,level", [(179, 0.8), (180, 0.4), (364, 0.4), (365, 0.0), (None, 0.0)])
def test_new_account_levels(spark, age, level):
    assert score_claims(silver_of(spark, [claim(1, age=age)])).collect()[0].sig_new_account == level


@pytest.mark.parametrize("verified,level", [(True, 0.0), (False, 1.0), (None, 0.0)])
def test_id_unverified_null_is_zero(spark, verified, level):
    assert score_claims(silver_of(spark, [claim(1, verified=verified)])).collect()[0].sig_id_unverified == level


@pytest.mark.parametrize("lien,level", [(True, 0.6), (False, 0.0), (None, 0.0)])
def test_lien_null_is_zero(spark, lien, level):
    assert score_claims(silver_of(spark, [claim(1, lien=lien)])).collect()[0].sig_lien == level


def test_max_score_and_tiers(spark):
    # every signal at its maximum: velocity 5 -> 1.0
    rows = [claim(i, amount=300000.0, pct=50.0, verified=False, lien=True, age=10) for i in range(5)]
    g = score_claims(silver_of(spark, rows)).collect()
    assert {r.fraud_risk_score for r in g} == {0.972}
    assert {r.risk_tier for r in g} == {"HIGH"}
    assert {r.primary_alert for r in g} == {K.ALERT_IDENTITY}


def test_tier_thresholds_inclusive(spark):
    from pyspark.sql import functions as F
    from claimscope.functions.scoring import risk_tier

    df = spark.createDataFrame([(0.75,), (0.749,), (0.45,), (0.449,), (None,)], "s double")
    got = [r.t for r in df.select(risk_tier(F.col("s")).alias("t")).collect()]
    assert got == ["HIGH", "MEDIUM", "MEDIUM", "LOW", "LOW"]


def test_all_alert_branches_with_low_thresholds(spark):
    rows = [
        claim(1, verified=False, amount=300000.0, pct=50.0),                      # identity
        *[claim(10 + i, claimant="V", amount=300000.0, pct=50.0) for i in range(5)],  # velocity
        claim(2, claimant="P", pct=45.0),                                          # property (MEDIUM)
        claim(3, claimant="M", amount=300000.0, lien=True, age=10, pct=25.0),      # multi or property
        claim(4, claimant="N"),                                                    # none
    ]
    g = score_claims(silver_of(spark, rows), high=0.30, medium=0.15).collect()
    alerts = {r.claim_id: r.primary_alert for r in g}
    assert alerts["CLM-2024-1"] == K.ALERT_IDENTITY
    assert alerts["CLM-2024-10"] == K.ALERT_VELOCITY
    assert alerts["CLM-2024-2"] == K.ALERT_PROPERTY
    assert alerts["CLM-2024-4"] == K.ALERT_NONE
    multi = score_claims(silver_of(spark, [claim(5, claimant="Q", amount=300000.0, lien=True, age=10)]),
                         high=0.15, medium=0.10).collect()[0]
    assert multi.primary_alert == K.ALERT_MULTI


def test_gold_contract_and_summary(spark):
    rows = [claim(i, claimant=f"C{i % 3}", amount=1000.0 * (i + 1), verified=i % 2 == 0) for i in range(9)]
    g = gold_score(silver_of(spark, rows), scored_at=dt.datetime(2024, 6, 30))
    assert tuple(g.columns) == K.GOLD_COLUMNS
    s = tier_summary(g).collect()
    assert sum(r.claims for r in s) == 9
    scores = [r.avg_score for r in s]
    assert scores == sorted(scores, reverse=True)
