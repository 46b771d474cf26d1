"""Investigation queue and claim validation (distributed; nothing is collected)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope import constants as K

QUEUE_STATUSES = ("OPEN", "UNDER_REVIEW")


def pending_queue(
    gold: DataFrame,
    min_score: float = K.HIGH_THRESHOLD,
    min_amount: float = K.ALERT_AMOUNT_MIN,
    audit: DataFrame | None = None,
    ordered: bool = True,
) -> DataFrame:
    """HIGH claims in OPEN/UNDER_REVIEW with score >= ``min_score`` and amount
    >= ``min_amount``: the 15 queue columns, score descending.

    With ``audit``, claims already in the audit log are removed (left anti
    join on claim_id), so a re-run does not investigate them again.
    """
    q = gold.filter(
        (F.col("risk_tier") == "HIGH")
        & F.col("claim_status").isin(*QUEUE_STATUSES)
        & (F.col("fraud_risk_score") >= F.lit(float(min_score)))
        & (F.col("claim_amount") >= F.lit(float(min_amount)))
    ).select(*K.QUEUE_COLUMNS)
    if audit is not None:
        q = q.join(audit.select("claim_id"), "claim_id", "left_anti").select(*K.QUEUE_COLUMNS)
    if ordered:
        q = q.orderBy(F.col("fraud_risk_score").desc(), F.col("claim_id"))
    return q


def claim_lookup(gold: DataFrame, claim_id: str | DataFrame) -> DataFrame:
    """Claims by id (the queue columns): one id, or the ids of a DataFrame
    (``claim_id`` column; a left semi join, so duplicates never multiply rows)."""
    if isinstance(claim_id, DataFrame):
        return gold.join(claim_id.select("claim_id"), "claim_id", "left_semi").select(*K.QUEUE_COLUMNS)
    return gold.filter(F.col("claim_id") == F.lit(claim_id)).select(*K.QUEUE_COLUMNS)


def queue_dry_run(queue: DataFrame) -> DataFrame:
    """The ids that an investigation run would process."""
    return queue.select("claim_id")


def _violation(cond_bad: Column, code: str) -> Column:
    return F.when(F.coalesce(cond_bad, F.lit(True)), F.lit(code))


def claim_violations() -> Column:
    """Array of violated input rules of a queue row (empty when valid)."""
    amount, score = F.col("claim_amount"), F.col("fraud_risk_score")
    checks = [
        _violation(~F.col("claim_id").rlike(K.CLAIM_ID_PATTERN), "claim_id_pattern"),
        _violation(F.col("claimant_id").isNull(), "claimant_id_missing"),
        _violation(F.col("property_id").isNull(), "property_id_missing"),
        _violation(~(amount > 0) | F.isnan(amount), "claim_amount_not_positive"),
        _violation(~((score >= 0) & (score <= 1)) | F.isnan(score), "fraud_risk_score_range"),
        _violation(~F.col("risk_tier").isin(*K.RISK_TIERS), "risk_tier_domain"),
        _violation(F.col("primary_alert").isNull(), "primary_alert_missing"),
        _violation(F.length("state") != 2, "state_length"),
        _violation(F.col("claim_type").isNull(), "claim_type_missing"),
        _violation(F.col("id_verified").isNull(), "id_verified_missing"),
        _violation(F.col("value_pct_change").isNull(), "value_pct_change_missing"),
        _violation(~(F.col("claim_velocity_24mo") >= 0), "claim_velocity_negative"),
        _violation(F.col("has_lien").isNull(), "has_lien_missing"),
        _violation(~(F.col("account_age_days") >= 0), "account_age_negative"),
        _violation(F.col("assigned_investigator").isNull(), "assigned_investigator_missing"),
    ]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def claim_validate(queue: DataFrame) -> DataFrame:
    """Queue rows with ``violations`` (array) and ``is_valid``; a valid row's
    state is upper-cased.  Split with ``valid_claims`` / ``quarantined_claims``
    so no row is lost."""
    v = queue.withColumn("violations", claim_violations())
    ok = F.size("violations") == 0
    return v.withColumns({"is_valid": ok, "state": F.when(ok, F.upper("state")).otherwise(F.col("state"))})


def valid_claims(validated: DataFrame) -> DataFrame:
    return validated.filter(F.col("is_valid")).drop("violations", "is_valid")


def quarantined_claims(validated: DataFrame) -> DataFrame:
    return validated.filter(~F.col("is_valid")).drop("is_valid")
