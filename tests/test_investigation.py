"""Queue, validation, rules, reply parsing, decision fallback, report/audit."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from claimscope import constants as K
from claimscope.operators import decide as D
from claimscope.operators import queue as Q
from claimscope.operators import replies as R
from claimscope.operators import report as Rp
from claimscope.operators import rules as RU
from claimscope.plans.investigate import investigate

GOLDEN = dict(
    claim_id="CLM-2024-7734", claimant_id="CLM-ID-10042", property_id="PROP-20187", state="TX",
    claim_type="WIRE_FRAUD", claim_amount=182400.0, fraud_risk_score=0.94, risk_tier="HIGH",
    primary_alert="IDENTITY_VERIFICATION_REQUIRED", id_verified=False, value_pct_change=31.4,
    claim_velocity_24mo=3, has_lien=True, account_age_days=145, assigned_investigator="J.Rivera",
)
QUEUE_SCHEMA = (
    "claim_id string, claimant_id string, property_id string, state string, claim_type string, "
    "claim_amount double, fraud_risk_score double, risk_tier string, primary_alert string, id_verified boolean, "
    "value_pct_change double, claim_velocity_24mo bigint, has_lien boolean, account_age_days bigint, "
    "assigned_investigator string"
)


def queue_df(spark, *rows):
    return spark.createDataFrame([tuple(r[c] for c in K.QUEUE_COLUMNS) for r in rows], QUEUE_SCHEMA)


def test_golden_claim_rules(spark):
    df = RU.apply_rules(queue_df(spark, GOLDEN)).collect()[0]
    assert df.rule_identity_status == "FLAGGED"
    assert df.rule_property_status == "ANOMALY_DETECTED"
    assert df.rule_pattern_status == "MATCH_FOUND"
    assert df.rule_sar_required is True
    assert df.rule_alta_practices == ["7"]
    assert df.state_disclosure_days == 10


def test_disclosure_lookup_case_and_unknown(spark):
    df = spark.createDataFrame([("tx",), ("ZZ",), (None,)], "state string")
    assert [r.d for r in df.select(RU.disclosure_days(F.col("state")).alias("d")).collect()] == [10, None, None]


def test_validation_splits_without_loss(spark):
    bad = dict(GOLDEN, claim_id="BAD-1", property_id=None, state="Texas", claim_amount=0.0)
    ok = dict(GOLDEN, claim_id="CLM-2024-1", state="tx")
    v = Q.claim_validate(queue_df(spark, bad, ok))
    valid, quarantined = Q.valid_claims(v).collect(), Q.quarantined_claims(v).collect()
    assert len(valid) + len(quarantined) == 2
    assert valid[0].state == "TX"
    assert set(quarantined[0].violations) == {
        "claim_id_pattern", "property_id_missing", "state_length", "claim_amount_not_positive"
    }


def test_pending_queue_filters_and_anti_join(spark):
    rows = [
        dict(GOLDEN, claim_id="CLM-2024-1"),
        dict(GOLDEN, claim_id="CLM-2024-2", claim_amount=49999.0),
        dict(GOLDEN, claim_id="CLM-2024-3", risk_tier="MEDIUM"),
        dict(GOLDEN, claim_id="CLM-2024-4", fraud_risk_score=0.97),
    ]
    gold = queue_df(spark, *rows).withColumn("claim_status", F.lit("UNDER_REVIEW"))
    q = Q.pending_queue(gold).collect()
    assert [r.claim_id for r in q] == ["CLM-2024-4", "CLM-2024-1"]
    audit = spark.createDataFrame([("CLM-2024-4",)], "claim_id string")
    assert [r.claim_id for r in Q.pending_queue(gold, audit=audit).collect()] == ["CLM-2024-1"]


CASES = [
    ("not json {", "ERROR", 0.0, "MALFORMED_JSON"),
    ("{}", "CLEAR", 0.0, None),
    ('{"status": "MAYBE"}', "ERROR", 0.0, "INVALID_STATUS"),
    ('{"status": "FLAGGED", "risk_delta": 5}', "ERROR", 0.0, "RISK_DELTA_OUT_OF_RANGE"),
    ('{"status": "FLAGGED", "risk_delta": null}', "ERROR", 0.0, "INVALID_RISK_DELTA"),
    ('{"status": "FLAGGED", "risk_delta": "0.1"}', "FLAGGED", 0.1, None),
    ('{"status": "FLAGGED", "risk_delta": true}', "FLAGGED", 1.0, None),
    (None, "ERROR", 0.0, "NO_REPLY"),
    ('{"status": "FLAGGED", "risk_delta": "0.1d"}', "ERROR", 0.0, "INVALID_RISK_DELTA"),
    ('{"status": "FLAGGED", "risk_delta": "0.1f"}', "ERROR", 0.0, "INVALID_RISK_DELTA"),
    ('{"status": "FLAGGED", "risk_delta": "0x1p-1"}', "ERROR", 0.0, "INVALID_RISK_DELTA"),
    ('{"status": "FLAGGED", "risk_delta": "nan"}', "ERROR", 0.0, "INVALID_RISK_DELTA"),
    ('{"status": "FLAGGED", "risk_delta": " 1_0e-2\\t"}', "FLAGGED", 0.1, None),
    ('{"status": "FLAGGED", "risk_delta": "1__0"}', "ERROR", 0.0, "INVALID_RISK_DELTA"),
    ('{"status": "FLAGGED", "ssn_discrepancies": "1_0"}', "FLAGGED", 0.0, None),
    ("[1, 2, 3]", "ERROR", 0.0, "NOT_AN_OBJECT"),
    ('"text"', "ERROR", 0.0, "NOT_AN_OBJECT"),
    ('{"status": "FLAGGED", "ssn_discrepancies": 3.0}', "FLAGGED", 0.0, None),
    ('{"status": "FLAGGED", "ssn_discrepancies": 3.5}', "ERROR", 0.0, "INVALID_SSN_DISCREPANCIES"),
    ('{"status": "FLAGGED", "ssn_discrepancies": "3"}', "FLAGGED", 0.0, None),
    ('{"status": "FLAGGED", "watchlist_match": "yes"}', "FLAGGED", 0.0, None),
    ('{"status": "FLAGGED", "watchlist_match": "maybe"}', "ERROR", 0.0, "INVALID_WATCHLIST_MATCH"),
    ('{"status": "FLAGGED", "findings": ["a", 1]}', "ERROR", 0.0, "INVALID_FINDINGS"),
    ('{"status": "FLAGGED", "findings": ["a", null]}', "ERROR", 0.0, "INVALID_FINDINGS"),
    ('{"status": "FLAGGED", "findings": null}', "ERROR", 0.0, "INVALID_FINDINGS"),
    ('{"status": "FLAGGED", "recommendation": 5}', "ERROR", 0.0, "INVALID_RECOMMENDATION"),
    ('{"status": "ERROR", "findings": ["x"]}', "ERROR", 0.0, None),
]


@pytest.mark.parametrize("raw,status,delta,reason", CASES)
def test_identity_reply_parsing(spark, raw, status, delta, reason):
    replies = spark.createDataFrame([("CLM-2024-1", "identity", raw)], "claim_id string, agent string, raw_response string")
    r = R.reply_parse(replies, "identity").collect()[0].result
    assert (r.status, r.risk_delta, r.error_reason) == (status, delta, reason)
    if reason is not None:
        assert r.findings == [f"Agent error: {reason}"] and r.recommendation == "MANUAL_REVIEW_REQUIRED"


def test_claim_dependent_defaults(spark):
    claims = spark.createDataFrame([("CLM-2024-1", 31.4, True, "tx")],
                                   "claim_id string, value_pct_change double, has_lien boolean, state string")
    replies = spark.createDataFrame(
        [("CLM-2024-1", "property", '{"status": "ANOMALY_DETECTED"}'),
         ("CLM-2024-1", "compliance", '{"status": "ACTION_REQUIRED"}'),
         ("CLM-2024-1", "claims_pattern", '{"status": "MATCH_FOUND", "pattern_cohort": null}')],
        "claim_id string, agent string, raw_response string")
    p = R.reply_parse(replies, "property", claims).collect()[0].result
    c = R.reply_parse(replies, "compliance", claims).collect()[0].result
    m = R.reply_parse(replies, "claims_pattern", claims).collect()[0].result
    assert (p.value_change_pct, p.lien_count) == (31.4, 1)
    assert c.state_disclosure_days == 10
    assert m.status == "MATCH_FOUND" and m.pattern_cohort is None
    explicit_null = spark.createDataFrame(
        [("CLM-2024-1", "compliance", '{"status": "CLEAR", "state_disclosure_days": null}')],
        "claim_id string, agent string, raw_response string")
    assert R.reply_parse(explicit_null, "compliance", claims).collect()[0].result.state_disclosure_days is None


def test_reply_select_first_assistant(spark):
    threads = spark.createDataFrame(
        [(1, 0, "user", "q"), (1, 2, "assistant", "second"), (1, 1, "assistant", "first"), (2, 0, "user", "q")],
        "thread_id long, turn long, role string, text string")
    got = {r.thread_id: r.raw_response for r in R.reply_select(threads).collect()}
    assert got == {1: "first", 2: "{}"}


def test_replies_from_threads(spark):
    threads = spark.createDataFrame(
        [(1, 0, "user", "q"), (1, 1, "assistant", '{"status": "FLAGGED"}'), (2, 0, "user", "q"),
         (3, 1, "assistant", "ignored")],
        "thread_id long, turn long, role string, text string")
    index = spark.createDataFrame([(1, "CLM-2024-1", "identity"), (2, "CLM-2024-1", "property"),
                                   (4, "CLM-2024-1", "compliance")],
                                  "thread_id long, claim_id string, agent string")
    got = sorted(tuple(r) for r in R.replies_from_threads(threads, index).collect())
    assert got == [("CLM-2024-1", "compliance", "{}"), ("CLM-2024-1", "identity", '{"status": "FLAGGED"}'),
                   ("CLM-2024-1", "property", "{}")]


@pytest.mark.parametrize("flags,action", [(0, "STANDARD_REVIEW"), (1, "REQUEST_DOCUMENTATION"),
                                          (2, "ESCALATE_TO_SIU"), (3, "PLACE_PAYOUT_HOLD"),
                                          (4, "PLACE_PAYOUT_HOLD")])
def test_fallback_decision(spark, flags, action):
    flagged = {"identity": "FLAGGED", "property": "ANOMALY_DETECTED", "claims_pattern": "MATCH_FOUND",
               "compliance": "ACTION_REQUIRED"}
    rows = []
    for i, agent in enumerate(K.AGENTS):
        status = flagged[agent] if i < flags else "CLEAR"
        rows.append(("CLM-2024-1", agent, f'{{"status": "{status}", "risk_delta": 0.1}}'))
    rows.append(("CLM-2024-1", "orchestrator", "not json"))
    replies = spark.createDataFrame(rows, "claim_id string, agent string, raw_response string")
    claims = spark.createDataFrame([("CLM-2024-1", 0.5, 1.0, True, "TX")],
                                   "claim_id string, fraud_risk_score double, value_pct_change double, has_lien boolean, state string")
    parsed = R.agents_pivot(replies.join(claims, "claim_id"))
    d = D.synthesis_parse(D.decide_fallback(parsed)).collect()[0]
    assert d.flagged_count == flags and d.recommended_action == action and d.used_fallback
    assert d.composite_fraud_probability == pytest.approx(0.9)
    assert d.action_rationale.startswith(f"Fallback decision: {flags}/4 agents flagged this claim.")
    assert d.quarantine_reason is None


@pytest.mark.parametrize("synth,reason,action", [
    ('{"recommended_action": "FREEZE"}', "INVALID_RECOMMENDED_ACTION", None),
    ('{"composite_fraud_probability": 1.5}', "PROBABILITY_OUT_OF_RANGE", None),
    ('{"composite_fraud_probability": null}', "INVALID_COMPOSITE_FRAUD_PROBABILITY", None),
    ('[1]', "SYNTHESIS_NOT_AN_OBJECT", None),
    ('{}', None, "STANDARD_REVIEW"),
    ('{"composite_fraud_probability": "0.8", "recommended_action": "ESCALATE_TO_SIU"}', None, "ESCALATE_TO_SIU"),
])
def test_synthesis_parse(spark, synth, reason, action):
    rows = [("CLM-2024-1", a, "{}") for a in K.AGENTS] + [("CLM-2024-1", "orchestrator", synth)]
    replies = spark.createDataFrame(rows, "claim_id string, agent string, raw_response string")
    claims = spark.createDataFrame([("CLM-2024-1", 0.8, 1.0, True, "TX")],
                                   "claim_id string, fraud_risk_score double, value_pct_change double, has_lien boolean, state string")
    d = D.synthesis_parse(D.decide_fallback(R.agents_pivot(replies.join(claims, "claim_id")))).collect()[0]
    assert d.quarantine_reason == reason
    if action:
        assert d.recommended_action == action and d.composite_fraud_probability == 0.8


def test_end_to_end_investigation(spark):
    gold = queue_df(spark, GOLDEN, dict(GOLDEN, claim_id="CLM-2024-2", property_id=None)).withColumn(
        "claim_status", F.lit("OPEN"))
    replies = spark.createDataFrame(
        [("CLM-2024-7734", "identity", '{"status": "FLAGGED", "risk_delta": 0.2, "findings": ["a", "b", "c"]}'),
         ("CLM-2024-7734", "property", '{"status": "ANOMALY_DETECTED", "risk_delta": 0.1}'),
         ("CLM-2024-7734", "claims_pattern", '{"status": "MATCH_FOUND"}'),
         ("CLM-2024-7734", "orchestrator", "down")],
        "claim_id string, agent string, raw_response string")
    inv = investigate(gold, replies, investigated_at=dt.datetime(2024, 1, 2, 3, 4, 5))
    audit = inv.audit.collect()
    assert len(audit) == 1 and inv.invalid_claims.count() == 1
    a = audit[0]
    assert (a.identity_status, a.property_status, a.pattern_status, a.compliance_status) == (
        "FLAGGED", "ANOMALY_DETECTED", "MATCH_FOUND", "ERROR")  # no compliance reply: never "all clear"
    assert a.recommended_action == "PLACE_PAYOUT_HOLD" and a.composite_fraud_probability == 0.99
    assert a.investigated_at == "2024-01-02T03:04:05" and a.human_review_required
    assert tuple(inv.audit.columns) == Rp.AUDIT_COLUMNS
    top = Rp.report_top_findings(inv.report).filter(F.col("agent_name") == "IdentityVerificationAgent").collect()
    assert [t.finding for t in sorted(top, key=lambda t: t.finding_rank)] == ["a", "b"]


def test_absent_and_repeated_replies(spark):
    gold = queue_df(spark, GOLDEN).withColumn("claim_status", F.lit("OPEN"))
    none = spark.createDataFrame([], "claim_id string, agent string, raw_response string")
    inv = investigate(gold, none, investigated_at=dt.datetime(2024, 1, 2))
    a = inv.audit.collect()[0]
    assert {a.identity_status, a.property_status, a.pattern_status, a.compliance_status} == {"ERROR"}
    d = inv.decided.collect()[0]
    assert d.used_fallback and d.recommended_action == "STANDARD_REVIEW"  # the fallback of no flags
    assert d.identity_result.recommendation == "MANUAL_REVIEW_REQUIRED" and d.identity_result.error_reason == "NO_REPLY"
    rows = [(GOLDEN["claim_id"], "identity", '{"status": "FLAGGED"}', 2), (GOLDEN["claim_id"], "identity", None, 0),
            (GOLDEN["claim_id"], "identity", '{"status": "CLEAR"}', 5), ("CLM-1999-1", "identity", "{}", 1)]
    replies = spark.createDataFrame(rows, "claim_id string, agent string, raw_response string, turn int")
    inv = investigate(gold, replies, investigated_at=dt.datetime(2024, 1, 2))
    assert inv.audit.collect()[0].identity_status == "FLAGGED"
    assert [(r.raw_response, r.reply_number) for r in inv.repeated_replies.collect()] == [('{"status": "CLEAR"}', 2)]
    assert [r.claim_id for r in R.unclaimed_replies(replies, gold).collect()] == ["CLM-1999-1"]
