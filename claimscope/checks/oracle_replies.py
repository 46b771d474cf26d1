"""DuckDB oracle SQL for the investigation operators: the replies fixture,
typed reply parsing, pivot, fallback decision, synthesis and audit rows."""

from __future__ import annotations

from claimscope.checks import oracle as O

STATUSES = "('FLAGGED', 'ANOMALY_DETECTED', 'MATCH_FOUND', 'ACTION_REQUIRED', 'CLEAR', 'ERROR')"
DECISIONS = "('PLACE_PAYOUT_HOLD', 'ESCALATE_TO_SIU', 'REQUEST_DOCUMENTATION', 'STANDARD_REVIEW', 'CLEAR_FOR_PAYMENT')"
AGENTS = ("identity", "property", "claims_pattern", "compliance")
FLAG = {"identity": "FLAGGED", "property": "ANOMALY_DETECTED", "claims_pattern": "MATCH_FOUND",
        "compliance": "ACTION_REQUIRED"}
DISPLAY = {"identity": "IdentityVerificationAgent", "property": "PropertyHistoryAgent",
           "claims_pattern": "ClaimsPatternAgent", "compliance": "RegulatoryComplianceAgent"}
DISCLOSURE = (
    "case upper(state) when 'TX' then 10 when 'FL' then 15 when 'CA' then 20 when 'NY' then 30 when 'IL' then 15 "
    "when 'AZ' then 10 when 'GA' then 15 when 'NC' then 15 when 'OH' then 20 when 'PA' then 20 end"
)


def _v(e: str) -> str:
    return f"cast({e} AS varchar)"


def _whole(n: int) -> str:
    return f"case when k % 11 = 5 then concat('\"', {_v(f'k % {n}')}, '.00\"') else {_v(f'k % {n}')} end"


def _flag(true: str) -> str:
    return f"case when k % 13 = 4 then '\" true \"' when {true} then 'true' else 'false' end"


def _valid_text(agent: str, status: str) -> str:
    common = (
        f"'{{\"status\": \"{status}\", \"findings\": [\"finding one for ', {_v('k')}, "
        f"'\", \"finding two for ', {_v('k')}, '\", \"finding three for ', {_v('k')}, "
        f"'\"], \"risk_delta\": 0.', lpad({_v('5 + (k % 7) * 5')}, 2, '0')"
    )
    if agent == "identity":
        extra = (
            f"', \"ssn_discrepancies\": ', {_whole(6)}, ', \"address_changes_18mo\": ', {_v('k % 4')}, "
            f"', \"watchlist_match\": ', {_flag('k % 2 = 0')}, "
            f"', \"id_doc_issues\": [\"doc issue ', {_v('k % 3')}, "
            "'\"], \"recommendation\": \"REQUEST_IN_PERSON_VERIFICATION\"}'"
        )
    elif agent == "property":
        extra = (
            f"', \"value_change_pct\": ', {_v('k % 50')}, '.5, \"title_transfers_24mo\": ', {_whole(5)}, "
            f"', \"comparable_sale_gap_pct\": ', {_v('k % 30')}, ', \"lien_count\": ', {_v('k % 3')}, "
            "', \"recommendation\": \"ORDER_INDEPENDENT_APPRAISAL\"}'"
        )
    elif agent == "claims_pattern":
        extra = (
            "', \"pattern_cohort\": ', case when k % 2 = 0 then '\"WIRE_FRAUD_RING\"' else 'null' end, "
            f"', \"cohort_similarity_pct\": ', {_v('k % 100')}, "
            "', \"shared_identifiers\": [\"phone\", \"bank account\"], \"prior_denied_claims\": ', "
            f"{_whole(4)}, ', \"recommendation\": \"ESCALATE_TO_SIU\"}}'"
        )
    else:
        extra = (
            f"', \"sar_required\": ', {_flag('k % 4 <> 0')}, "
            "', \"alta_practices_triggered\": [\"7\"]', "
            f"case when k % 3 = 0 then concat(', \"state_disclosure_days\": ', {_v('5 + k % 20')}) "
            "when k % 3 = 1 then ', \"state_disclosure_days\": null' else '' end, "
            "', \"regulatory_notes\": [\"notify within window\"], \"recommendation\": \"INITIATE_SAR_FILING\"}'"
        )
    return f"concat({common}, {extra})"


def _agent_text(agent: str) -> str:
    flag = FLAG[agent]
    cls = f"((k + {3 * AGENTS.index(agent)}) % 10)"
    return (
        f"case when {cls} = 0 then concat('not json {{', {_v('k')}) "
        f"when {cls} = 1 then '{{}}' "
        f"when {cls} = 2 then '{{\"status\": \"MAYBE\", \"risk_delta\": 0.1}}' "
        f"when {cls} = 3 then '{{\"status\": \"{flag}\", \"risk_delta\": 5}}' "
        f"when {cls} = 4 then '{{\"status\": \"{flag}\", \"risk_delta\": null}}' "
        f"when {cls} = 5 then concat('{{\"status\": \"{flag}\", \"risk_delta\": \"', case (k // 10) % 8 when 0 then '0.1' "
        "when 1 then '0.1d' when 2 then '0.1f' when 3 then '0x1p-1' when 4 then '1_0e-2' when 5 then ' 0.1 ' "
        "when 6 then '1__0e-2' else '-.25' end, '\"}') "
        f"when {cls} = 6 then '[1, 2, 3]' "
        f"when {cls} <= 8 then {_valid_text(agent, flag)} "
        f"else {_valid_text(agent, 'CLEAR')} end"
    )


SYNTH_TEXT = (
    "case when k % 8 = 0 then 'synthesis unavailable' when k % 8 = 1 then '{}' "
    "when k % 8 = 2 then '{\"composite_fraud_probability\": 0.9, \"recommended_action\": \"FREEZE_ACCOUNT\", "
    "\"action_rationale\": \"x\"}' "
    "when k % 8 = 3 then '{\"composite_fraud_probability\": 1.5, \"recommended_action\": \"ESCALATE_TO_SIU\", "
    "\"action_rationale\": \"x\"}' "
    "when k % 8 = 4 then '{\"composite_fraud_probability\": \"0.8\", \"recommended_action\": \"REQUEST_DOCUMENTATION\"}' "
    "else concat('{\"composite_fraud_probability\": 0.', cast(50 + k % 45 AS varchar), ', \"recommended_action\": \"', "
    "case k % 5 when 0 then 'PLACE_PAYOUT_HOLD' when 1 then 'ESCALATE_TO_SIU' when 2 then 'REQUEST_DOCUMENTATION' "
    "when 3 then 'STANDARD_REVIEW' else 'CLEAR_FOR_PAYMENT' end, '\", \"action_rationale\": \"Rationale for claim ', "
    "cast(k AS varchar), '.\"}') end"
)

REPLIES = (
    "\nreply_keys AS (SELECT concat('CLM-', cast(extract(year FROM o_orderdate) AS varchar), '-', "
    "cast(7000 + o_orderkey AS varchar)) AS claim_id, o_orderkey AS k FROM orders),\n"
    "replies AS ("
    + " UNION ALL ".join(
        f"SELECT claim_id, '{a}' AS agent, case when (k + {5 * i}) % 17 <> 1 then {text} end AS raw_response, 1 AS turn "
        f"FROM reply_keys WHERE (k + {5 * i}) % 17 <> 0 "
        f"UNION ALL SELECT claim_id, '{a}' AS agent, '{{}}' AS raw_response, 2 AS turn FROM reply_keys WHERE (k + {5 * i}) % 17 = 2"
        for i, (a, text) in enumerate([*((a, _agent_text(a)) for a in AGENTS), ("orchestrator", SYNTH_TEXT)])
    )
    + ")"
)

# ---------------------------------------------------------------------------
# typed field extraction (r = the reply when it is a JSON object, else NULL)
# ---------------------------------------------------------------------------

_DIGITS = "[0-9]+(_[0-9]+)*"
FLOAT_TEXT = rf"[+-]?({_DIGITS}[.]?({_DIGITS})?|[.]{_DIGITS})([eE][+-]?{_DIGITS})?"
INT_TEXT = f"[+-]?{_DIGITS}"

TRUE_WORDS = "('1', 'true', 't', 'yes', 'y', 'on')"
FALSE_WORDS = "('0', 'false', 'f', 'no', 'n', 'off')"


def _obj(raw: str) -> str:
    return f"(case when json_valid({raw}) then case when json_type({raw}) = 'OBJECT' then {raw} end end)"


def field_sql(r: str, name: str, kind: str) -> tuple[str, str, str]:
    """(missing, value, ok) SQL of field ``name`` for object text ``r``."""
    t = f"json_type({r}, '$.{name}')"
    s = f"json_extract_string({r}, '$.{name}')"
    d = f"try_cast({s} AS double)"
    missing = f"({t} IS NULL)"
    num = f"{t} IN ('BIGINT', 'UBIGINT', 'DOUBLE')"
    if kind == "float":
        val = (f"(case when {num} then try_cast({s} AS double) when {t} = 'VARCHAR' then case when "
               f"regexp_full_match(trim({s}), '{FLOAT_TEXT}') then try_cast(replace(trim({s}), '_', '') AS double) end "
               f"when {t} = 'BOOLEAN' then case when {s} = 'true' then 1.0 else 0.0 end end)")
        ok = f"({val} IS NOT NULL)"
    elif kind in ("int", "opt_int"):
        val = (f"(case when {t} IN ('BIGINT', 'UBIGINT') then try_cast({s} AS bigint) "
               f"when {t} = 'DOUBLE' and {d} = floor({d}) then cast({d} AS bigint) "
               f"when {t} = 'BOOLEAN' then case when {s} = 'true' then 1 else 0 end "
               f"when {t} = 'VARCHAR' and regexp_full_match(split_part(trim({s}), '.', 1), '{INT_TEXT}') "
               f"and (not contains({s}, '.') or replace(split_part(trim({s}), '.', 2), '0', '') = '' and trim({s}) not like '%.') "
               f"then try_cast(replace(split_part(trim({s}), '.', 1), '_', '') AS bigint) end)")
        ok = f"({val} IS NOT NULL)" if kind == "int" else f"({t} = 'NULL' or {val} IS NOT NULL)"
    elif kind == "bool":
        val = (f"(case when {t} = 'BOOLEAN' then {s} = 'true' "
               f"when {num} and {d} IN (0, 1) then {d} = 1 "
               f"when {t} = 'VARCHAR' and lower({s}) IN {TRUE_WORDS} then true "
               f"when {t} = 'VARCHAR' and lower({s}) IN {FALSE_WORDS} then false end)")
        ok = f"({val} IS NOT NULL)"
    elif kind in ("str", "opt_str"):
        val = f"(case when {t} = 'VARCHAR' then {s} end)"
        ok = f"({val} IS NOT NULL)" if kind == "str" else f"({t} = 'NULL' or {val} IS NOT NULL)"
    elif kind == "str_list":
        ok = (f"({t} = 'ARRAY' and coalesce(list_bool_and(list_transform(json_type({r}, '$.{name}[*]'), "
              f"lambda x: x = 'VARCHAR')), true))")
        val = f"(case when {ok} then array_to_string(json_extract_string({r}, '$.{name}[*]'), '|') end)"
    elif kind == "status":
        val = f"(case when {t} = 'VARCHAR' and {s} IN {STATUSES} then {s} end)"
        ok = f"({val} IS NOT NULL)"
    else:
        raise ValueError(kind)
    return missing, val, ok


COMMON_HEAD = [("status", "status", "'CLEAR'", "'ERROR'")]
COMMON_TAIL = [
    ("findings", "str_list", "''", None),
    ("risk_delta", "float", "0.0", "0.0"),
    ("recommendation", "str", "'STANDARD_PROCESS'", "'MANUAL_REVIEW_REQUIRED'"),
]
FIELDS = {
    "identity": COMMON_HEAD + [
        ("ssn_discrepancies", "int", "0", "0"), ("address_changes_18mo", "int", "0", "0"),
        ("watchlist_match", "bool", "false", "false"), ("id_doc_issues", "str_list", "''", "''"),
    ] + COMMON_TAIL,
    "property": COMMON_HEAD + [
        ("value_change_pct", "float", "value_pct_change", "0.0"), ("title_transfers_24mo", "int", "0", "0"),
        ("comparable_sale_gap_pct", "float", "0.0", "0.0"),
        ("lien_count", "int", "case when has_lien then 1 else 0 end", "0"),
    ] + COMMON_TAIL,
    "claims_pattern": COMMON_HEAD + [
        ("pattern_cohort", "opt_str", "NULL", "NULL"), ("cohort_similarity_pct", "float", "0.0", "0.0"),
        ("shared_identifiers", "str_list", "''", "''"), ("prior_denied_claims", "int", "0", "0"),
    ] + COMMON_TAIL,
    "compliance": COMMON_HEAD + [
        ("sar_required", "bool", "false", "false"), ("alta_practices_triggered", "str_list", "''", "''"),
        ("state_disclosure_days", "opt_int", DISCLOSURE, "NULL"), ("regulatory_notes", "str_list", "''", "''"),
    ] + COMMON_TAIL,
}


def parsed_columns(agent: str, raw: str, prefix: str) -> list[str]:
    """Flat SQL select items ``{prefix}{field}`` + ``{prefix}error_reason``
    for reply text ``raw`` (claim columns value_pct_change/has_lien/state in scope)."""
    r = _obj(raw)
    vals, oks = {}, []
    for name, kind, default, _ in FIELDS[agent]:
        missing, val, ok = field_sql(r, name, kind)
        vals[name] = f"(case when {missing} then {default} else {val} end)"
        oks.append((f"INVALID_{name.upper()}", f"({missing} or {ok})"))
    delta = vals["risk_delta"]
    oks.append(("RISK_DELTA_OUT_OF_RANGE", f"coalesce({delta} >= -1.0 and {delta} <= 1.0, false)"))
    reason = (f"(case when {raw} IS NULL then 'NO_REPLY' when not json_valid({raw}) then 'MALFORMED_JSON' "
              f"when {r} IS NULL then 'NOT_AN_OBJECT' "
              + " ".join(f"when not coalesce({ok}, false) then '{code}'" for code, ok in oks)
              + " end)")
    out = []
    for name, kind, _, err in FIELDS[agent]:
        if name == "findings":
            err = f"'Agent error: ' || {reason}"
        out.append(f"case when {reason} IS NULL then {vals[name]} else {err} end AS {prefix}{name}")
    out.append(f"{reason} AS {prefix}error_reason")
    return out


def claims_with_replies(body: str, queue_only: bool = False, min_amount: float = 50000.0) -> str:
    """``body`` over the gold views plus ``replies`` and ``claim_replies``
    (one row per claim: the four reply texts and the synthesis text)."""
    pivot = (
        "\nclaim_replies AS (SELECT claim_id, "
        + ", ".join(
            f"arg_min(raw_response, turn) FILTER (WHERE agent = '{a}' AND raw_response IS NOT NULL) AS raw_{a}"
            for a in AGENTS
        )
        + ", arg_min(raw_response, turn) FILTER (WHERE agent = 'orchestrator' AND raw_response IS NOT NULL) "
        "AS raw_synthesis FROM replies GROUP BY claim_id)"
    )
    base = O.with_ctes(*O.BASE, O.silver_cte(), O.scored_cte(), REPLIES, pivot)
    return base + "\n" + body


def parsed_all_sql(source: str) -> str:
    """SELECT of every claim in ``source`` (gold-like rows joined with
    claim_replies) with the four parsed agents flattened as ``{agent}_{field}``."""
    cols = []
    for a in AGENTS:
        cols += parsed_columns(a, f"raw_{a}", f"{a}_")
    return f"SELECT *, {', '.join(cols)} FROM {source}"


def decision_sql(parsed: str) -> str:
    """Fallback + synthesis over a parsed relation; adds flagged_count,
    composite_fraud_probability, recommended_action, action_rationale,
    used_fallback, quarantine_reason."""
    flags = " + ".join(f"cast({a}_status NOT IN ('CLEAR', 'ERROR') AS integer)" for a in AGENTS)
    deltas = "((identity_risk_delta + property_risk_delta) + claims_pattern_risk_delta) + compliance_risk_delta"
    fb_prob = f"least(0.99, fraud_risk_score + ({deltas}))"
    fb_action = (f"case when ({flags}) >= 3 then 'PLACE_PAYOUT_HOLD' when ({flags}) = 2 then 'ESCALATE_TO_SIU' "
                 f"when ({flags}) = 1 then 'REQUEST_DOCUMENTATION' else 'STANDARD_REVIEW' end")
    fb_text = (f"concat('Fallback decision: ', cast(({flags}) AS varchar), "
               "'/4 agents flagged this claim. Orchestrator synthesis failed — manual review required.')")
    r = _obj("raw_synthesis")
    p_missing, p_val, p_ok = field_sql(r, "composite_fraud_probability", "float")
    a_missing, a_val, a_ok = field_sql(r, "recommended_action", "str")
    t_missing, t_val, t_ok = field_sql(r, "action_rationale", "str")
    prob = f"(case when {p_missing} then fraud_risk_score else {p_val} end)"
    action = f"(case when {a_missing} then 'STANDARD_REVIEW' else {a_val} end)"
    text = f"(case when {t_missing} then '' else {t_val} end)"
    fallback = "(raw_synthesis IS NULL or not json_valid(raw_synthesis))"
    reason = (
        f"(case when {fallback} and not ({fb_prob} >= 0 and {fb_prob} <= 1) then 'PROBABILITY_OUT_OF_RANGE' "
        f"when {fallback} then NULL "
        f"when {r} IS NULL then 'SYNTHESIS_NOT_AN_OBJECT' "
        f"when not coalesce({p_missing} or {p_ok}, false) then 'INVALID_COMPOSITE_FRAUD_PROBABILITY' "
        f"when not coalesce({a_missing} or {a_ok}, false) or not coalesce({action} IN {DECISIONS}, false) "
        "then 'INVALID_RECOMMENDED_ACTION' "
        f"when not coalesce({t_missing} or {t_ok}, false) then 'INVALID_ACTION_RATIONALE' "
        f"when not coalesce({prob} >= 0 and {prob} <= 1, false) then 'PROBABILITY_OUT_OF_RANGE' end)"
    )
    return (
        f"SELECT *, ({flags}) AS flagged_count, {fb_prob} AS fallback_probability, {fb_action} AS fallback_action, "
        f"{fb_text} AS fallback_rationale, "
        f"case when {fallback} then {fb_prob} else {prob} end AS composite_fraud_probability, "
        f"case when {fallback} then {fb_action} else {action} end AS recommended_action, "
        f"case when {fallback} then {fb_text} else {text} end AS action_rationale, "
        f"{fallback} AS used_fallback, {reason} AS quarantine_reason FROM ({parsed}) p"
    )


QUEUE_WHERE = (
    "risk_tier = 'HIGH' AND claim_status IN ('OPEN', 'UNDER_REVIEW') AND fraud_risk_score >= 0.75 "
    "AND claim_amount >= {min_amount}"
)
VALID_WHERE = (
    "regexp_full_match(claim_id, 'CLM-[0-9]{4}-[0-9]+') AND claimant_id IS NOT NULL AND property_id IS NOT NULL "
    "AND claim_amount > 0 AND fraud_risk_score >= 0 AND fraud_risk_score <= 1 "
    "AND risk_tier IN ('HIGH', 'MEDIUM', 'LOW') AND primary_alert IS NOT NULL AND length(state) = 2 "
    "AND claim_type IS NOT NULL AND id_verified IS NOT NULL AND value_pct_change IS NOT NULL "
    "AND claim_velocity_24mo >= 0 AND has_lien IS NOT NULL AND account_age_days >= 0 "
    "AND assigned_investigator IS NOT NULL"
)


def queue_sql(min_amount: float = 50000.0) -> str:
    """Valid queue claims (state upper-cased) with their reply texts."""
    return (
        f"SELECT g.* REPLACE (upper(g.state) AS state), cr.* EXCLUDE (claim_id) FROM (SELECT * FROM gold "
        f"WHERE {QUEUE_WHERE.format(min_amount=min_amount)} AND {VALID_WHERE}) g "
        f"LEFT JOIN claim_replies cr ON g.claim_id = cr.claim_id"
    )


def audit_sql(body: str, min_amount: float = 50000.0) -> str:
    """``body`` over ``audit`` (13 columns) of the investigation of the queue."""
    queue = queue_sql(min_amount)
    decided = decision_sql(parsed_all_sql(f"({queue}) q"))
    audit = (
        "SELECT claim_id, claim_amount, fraud_risk_score AS original_fraud_score, composite_fraud_probability, "
        "recommended_action, true AS human_review_required, identity_status, property_status, "
        "claims_pattern_status AS pattern_status, compliance_status, compliance_sar_required AS sar_required, "
        "'2001-08-01T00:00:00' AS investigated_at, 'gpt-4o-fraud' AS model_version "
        f"FROM ({decided}) d WHERE quarantine_reason IS NULL"
    )
    return claims_with_replies(f", audit AS ({audit})\n{body}".replace("\n, audit", ", audit"), min_amount=min_amount)
