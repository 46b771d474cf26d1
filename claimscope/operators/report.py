"""Investigation report (nested), audit row (flat, 13 columns), top findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope import constants as K
from claimscope.functions.scoring import as_of_timestamp
from claimscope.operators.replies import RESULT_COLUMNS

AUDIT_COLUMNS = (
    "claim_id", "claim_amount", "original_fraud_score", "composite_fraud_probability", "recommended_action",
    "human_review_required", "identity_status", "property_status", "pattern_status", "compliance_status",
    "sar_required", "investigated_at", "model_version",
)


def iso_timestamp(ts: Column) -> Column:
    """ISO-8601 text of a timestamp: ``yyyy-MM-ddTHH:mm:ss`` plus
    ``.ffffff`` only when the microseconds are not zero."""
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.when(micros == "000000", base).otherwise(F.concat(base, F.lit("."), micros))


def investigation_report(
    decided: DataFrame, investigated_at=None, model_version: str = K.MODEL_VERSION
) -> DataFrame:
    """One nested report row per accepted claim: claim context, the four agent
    results, the decision, ``human_review_required`` (always true) and metadata."""
    accepted = decided.filter(F.col("quarantine_reason").isNull())
    strip = {c: F.col(c).dropFields("error_reason") for c in RESULT_COLUMNS.values()}
    return accepted.withColumns(strip).select(
        "claim_id",
        "claim_amount",
        F.col("fraud_risk_score").alias("original_fraud_score"),
        "risk_tier",
        *RESULT_COLUMNS.values(),
        "composite_fraud_probability",
        "recommended_action",
        "action_rationale",
        F.lit(True).alias("human_review_required"),
        as_of_timestamp(investigated_at).alias("investigated_at"),
        F.lit(model_version).alias("model_version"),
        F.lit(None).cast("string").alias("orchestrator_agent_id"),
        F.lit(None).cast("bigint").alias("total_latency_ms"),
    )


def audit_row(report: DataFrame) -> DataFrame:
    """Flatten reports to the 13 audit columns (timestamp as ISO text)."""
    return report.select(
        "claim_id",
        "claim_amount",
        "original_fraud_score",
        "composite_fraud_probability",
        "recommended_action",
        "human_review_required",
        F.col("identity_result.status").alias("identity_status"),
        F.col("property_result.status").alias("property_status"),
        F.col("claims_pattern_result.status").alias("pattern_status"),
        F.col("compliance_result.status").alias("compliance_status"),
        F.col("compliance_result.sar_required").alias("sar_required"),
        iso_timestamp(F.col("investigated_at")).alias("investigated_at"),
        "model_version",
    )


def report_top_findings(report: DataFrame, n: int = 2) -> DataFrame:
    """Status and the first ``n`` findings of every agent of every report:
    (claim_id, agent_name, status, finding_rank, finding)."""
    agents = F.array(*[
        F.struct(*[F.col(f"{c}.{n}").alias(n) for n in ("agent_name", "status", "findings")])
        for c in RESULT_COLUMNS.values()
    ])
    per_agent = report.select("claim_id", F.posexplode(agents).alias("agent_pos", "r"))
    return per_agent.select(
        "claim_id", "agent_pos", F.col("r.agent_name").alias("agent_name"), F.col("r.status").alias("status"),
        F.posexplode_outer(F.slice("r.findings", 1, n)).alias("finding_rank", "finding"),
    ).select("claim_id", "agent_name", "status", (F.col("finding_rank") + 1).alias("finding_rank"), "finding")


def quarantine(decided: DataFrame) -> DataFrame:
    """Claims whose decision could not be accepted, with the reason."""
    return decided.filter(F.col("quarantine_reason").isNotNull()).select(
        "claim_id", "quarantine_reason", "synthesis_raw"
    )
