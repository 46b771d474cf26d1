"""Agent request payloads as JSON text columns (``to_json(struct(...))``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.operators.rules import disclosure_days

REQUEST_FIELDS = {
    "identity": (
        "claim_id", "id_verified", "account_age_days", "claim_velocity_24mo", "state", "claim_amount", "claimant_id",
    ),
    "property": (
        "claim_id", "property_id", "value_pct_change", "has_lien", "state", "claim_type", "claim_amount",
    ),
    "claims_pattern": (
        "claim_id", "claimant_id", "claim_velocity_24mo", "fraud_risk_score", "primary_alert", "claim_type",
        "claim_amount", "state",
    ),
    "compliance": (
        "claim_id", "claim_amount", "claim_type", "state", "risk_tier", "fraud_risk_score", "primary_alert",
        "state_disclosure_days",
    ),
}


def request_json(agent: str) -> Column:
    """The request payload of ``agent`` for a claim row (nulls kept as JSON null)."""
    cols = []
    for name in REQUEST_FIELDS[agent]:
        if name == "state_disclosure_days":
            cols.append(disclosure_days(F.col("state")).alias(name))
        else:
            cols.append(F.col(name))
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def agent_requests(claims: DataFrame) -> DataFrame:
    """One request per claim and agent: (claim_id, agent, request)."""
    pairs = [F.struct(F.lit(a).alias("agent"), request_json(a).alias("request")) for a in REQUEST_FIELDS]
    return claims.select("claim_id", F.explode(F.array(*pairs)).alias("r")).select("claim_id", "r.agent", "r.request")


def synthesis_request(parsed: DataFrame) -> DataFrame:
    """The nested synthesis payload per claim: claim context plus each agent's
    status, delta (SAR flag for compliance) and findings."""
    def agent_part(col: str, compliance: bool = False) -> Column:
        second = F.col(f"{col}.sar_required").alias("sar_required") if compliance else F.col(
            f"{col}.risk_delta").alias("risk_delta")
        return F.struct(F.col(f"{col}.status").alias("status"), second, F.col(f"{col}.findings").alias("findings"))

    payload = F.struct(
        F.col("claim_id"),
        F.col("claim_amount"),
        F.col("fraud_risk_score").alias("original_score"),
        F.col("risk_tier"),
        agent_part("identity_result").alias("identity"),
        agent_part("property_result").alias("property"),
        agent_part("claims_pattern_result").alias("claims_pattern"),
        agent_part("compliance_result", compliance=True).alias("compliance"),
    )
    return parsed.select("claim_id", F.to_json(payload).alias("request"))
