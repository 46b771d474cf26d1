"""Property tests: score bounds, monotonicity in every signal, tier partition."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from claimscope.operators.gold import score_claims
from claimscope.operators.silver import silver_enrich

AS_OF = dt.date(2024, 6, 30)
SCHEMA = (
    "claim_id string, claimant_id string, property_id string, claim_type string, fraud_label string, "
    "is_confirmed_fraud boolean, claim_amount double, claim_status string, filed_date date, resolved_date date, "
    "assigned_investigator string, state string, id_verified boolean, value_pct_change double, has_lien boolean, "
    "account_age_days bigint"
)

row = st.tuples(
    st.integers(0, 4),                                   # claimant
    st.integers(0, 900),                                 # days before as_of
    st.floats(1.0, 400000.0, allow_nan=False),           # amount
    st.one_of(st.none(), st.floats(-10.0, 70.0, allow_nan=False)),
    st.one_of(st.none(), st.booleans()),                 # id_verified
    st.one_of(st.none(), st.booleans()),                 # has_lien
    st.one_of(st.none(), st.integers(0, 4000)),          # account age
)


def to_claims(spark, rows):
    data = [
        (f"CLM-2024-{i}", f"C{c}", f"P{i}", "LIEN", "NONE", False, amt, "OPEN", AS_OF - dt.timedelta(days=d), None,
         "J.Rivera", "TX", ver, pct, lien, age)
        for i, (c, d, amt, pct, ver, lien, age) in enumerate(rows)
    ]
    return spark.createDataFrame(data, SCHEMA)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(row, min_size=1, max_size=40))
def test_score_bounds_monotone_and_tiers(spark, rows):
    scored = score_claims(silver_enrich(to_claims(spark, rows), as_of=AS_OF)).collect()
    assert len(scored) == len(rows)
    tiers = {"HIGH": 0, "MEDIUM": 0, "LOW": 0}
    for r in scored:
        assert 0.0 <= r.fraud_risk_score <= 0.972
        tiers[r.risk_tier] += 1
        sigs = (r.sig_velocity, r.sig_id_unverified, r.sig_property_spike, r.sig_high_value, r.sig_new_account,
                r.sig_lien)
        assert all(0.0 <= s <= 1.0 for s in sigs)
    assert sum(tiers.values()) == len(rows)
    # monotone: a claim whose every signal is at least another's never scores lower
    for a in scored:
        for b in scored:
            sa = (a.sig_velocity, a.sig_id_unverified, a.sig_property_spike, a.sig_high_value, a.sig_new_account,
                  a.sig_lien)
            sb = (b.sig_velocity, b.sig_id_unverified, b.sig_property_spike, b.sig_high_value, b.sig_new_account,
                  b.sig_lien)
            if all(x >= y for x, y in zip(sa, sb, strict=True)):
                assert a.fraud_risk_score >= b.fraud_risk_score
