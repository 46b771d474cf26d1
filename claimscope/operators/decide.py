"""Decision: deterministic fallback and parsing of the synthesis reply.

The fallback (used when the synthesis reply is absent or not valid JSON) counts the
agents whose status is neither CLEAR nor ERROR and maps 3+/2/1/0 flags to
hold / escalate / documentation / standard review.  A synthesis that is
valid JSON but unusable (not an object, unknown action, probability outside
0..1 or of a wrong type, non-text rationale) goes to quarantine with a reason
instead of being dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope import constants as K
from claimscope.functions import reply_json as J
from claimscope.operators.replies import RESULT_COLUMNS

AGENT_ORDER = tuple(RESULT_COLUMNS.values())


def flagged_count_expr() -> Column:
    """Agents whose status is neither CLEAR nor ERROR."""
    terms = [(~F.col(f"{c}.status").isin("CLEAR", "ERROR")).cast("int") for c in AGENT_ORDER]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def composite_fallback_expr(score: str = "fraud_risk_score") -> Column:
    """``least(0.99, score + sum(deltas))`` with the deltas summed in agent order."""
    deltas = F.col(f"{AGENT_ORDER[0]}.risk_delta")
    for c in AGENT_ORDER[1:]:
        deltas = deltas + F.col(f"{c}.risk_delta")
    return F.least(F.lit(K.SCORE_CAP), F.col(score) + deltas)


def decision_fallback_expr(flags: Column) -> Column:
    return (
        F.when(flags >= 3, F.lit("PLACE_PAYOUT_HOLD"))
        .when(flags == 2, F.lit("ESCALATE_TO_SIU"))
        .when(flags == 1, F.lit("REQUEST_DOCUMENTATION"))
        .otherwise(F.lit("STANDARD_REVIEW"))
    )


def rationale_fallback_expr(flags: Column) -> Column:
    head, tail = K.FALLBACK_RATIONALE.split("{n}")
    return F.concat(F.lit(head), flags.cast("string"), F.lit(tail))


def decide_fallback(parsed: DataFrame) -> DataFrame:
    """Add flagged_count, fallback probability, action and rationale."""
    flags = flagged_count_expr()
    return parsed.withColumn("flagged_count", flags).withColumns(
        {
            "fallback_probability": composite_fallback_expr(),
            "fallback_action": decision_fallback_expr(F.col("flagged_count")),
            "fallback_rationale": rationale_fallback_expr(F.col("flagged_count")),
        }
    )


def synthesis_parse(decided: DataFrame, raw: str = "synthesis_raw") -> DataFrame:
    """Final probability / action / rationale per claim, with
    ``used_fallback`` and ``quarantine_reason`` (NULL when accepted)."""
    v = J.parse(F.col(raw))
    prob, prob_ok = J.extract(v, "composite_fraud_probability", "float", F.col("fraud_risk_score"))
    action_val, action_ok = J.extract(v, "recommended_action", "str", F.lit(K.DEFAULT_ACTION))
    rationale, rationale_ok = J.extract(v, "action_rationale", "str", F.lit(""))
    fallback = v.isNull()
    probability = F.when(fallback, F.col("fallback_probability")).otherwise(prob)
    action = F.when(fallback, F.col("fallback_action")).otherwise(action_val)
    text = F.when(fallback, F.col("fallback_rationale")).otherwise(rationale)
    reason = (
        F.when(fallback & ~((F.col("fallback_probability") >= 0) & (F.col("fallback_probability") <= 1)),
               F.lit("PROBABILITY_OUT_OF_RANGE"))
        .when(fallback, F.lit(None).cast("string"))
        .when(~J.is_object_text(F.col(raw), v), F.lit("SYNTHESIS_NOT_AN_OBJECT"))
        .when(~prob_ok, F.lit("INVALID_COMPOSITE_FRAUD_PROBABILITY"))
        .when(~action_ok | ~F.coalesce(action_val.isin(*K.DECISIONS), F.lit(False)), F.lit("INVALID_RECOMMENDED_ACTION"))
        .when(~rationale_ok, F.lit("INVALID_ACTION_RATIONALE"))
        .when(~F.coalesce((prob >= 0) & (prob <= 1), F.lit(False)), F.lit("PROBABILITY_OUT_OF_RANGE"))
    )
    return decided.withColumns(
        {
            "composite_fraud_probability": probability,
            "recommended_action": action,
            "action_rationale": text,
            "used_fallback": fallback,
            "quarantine_reason": reason,
        }
    )
