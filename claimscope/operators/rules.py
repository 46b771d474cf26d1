"""Deterministic agent rules as columns (statuses, strong signals, SAR, ALTA,
state disclosure window)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope import constants as K


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def disclosure_map() -> Column:
    """State -> disclosure days as a literal map (ten entries, no join needed)."""
    items = []
    for state, days in K.STATE_DISCLOSURE_DAYS.items():
        items += [F.lit(state), F.lit(days)]
    return F.create_map(*items)


def disclosure_days(state: Column) -> Column:
    """Disclosure window of a state (case-insensitive), NULL when unknown."""
    return F.try_element_at(disclosure_map(), F.upper(state))


def rule_identity_status(df: DataFrame) -> DataFrame:
    cond = (
        _true(F.col("id_verified") == F.lit(False))
        | _true(F.col("account_age_days") < K.IDENTITY_NEW_ACCOUNT_DAYS)
        | _true(F.col("claim_velocity_24mo") > K.IDENTITY_VELOCITY_GT)
    )
    return df.withColumn("rule_identity_status", F.when(cond, "FLAGGED").otherwise("CLEAR"))


def rule_property_status(df: DataFrame) -> DataFrame:
    cond = _true(F.col("value_pct_change") > K.PROPERTY_SPIKE_PCT) | _true(F.col("has_lien") == F.lit(True))
    return df.withColumn("rule_property_status", F.when(cond, "ANOMALY_DETECTED").otherwise("CLEAR"))


def rule_pattern_status(df: DataFrame) -> DataFrame:
    cond = _true(F.col("claim_velocity_24mo") > K.PATTERN_VELOCITY_GT) | _true(
        F.col("fraud_risk_score") > K.PATTERN_SCORE_GT
    )
    return df.withColumn("rule_pattern_status", F.when(cond, "MATCH_FOUND").otherwise("CLEAR"))


def rule_strong_signals(parsed: DataFrame) -> DataFrame:
    """Strong-signal flags over parsed replies: cohort similarity > 70, title
    transfers > 2, comparable-sale gap > 15."""
    return parsed.withColumns(
        {
            "strong_cohort_match": _true(F.col("claims_pattern_result.cohort_similarity_pct")
                                         > K.COHORT_SIMILARITY_STRONG_GT),
            "strong_title_transfers": _true(F.col("property_result.title_transfers_24mo")
                                            > K.TITLE_TRANSFERS_STRONG_GT),
            "strong_comparable_gap": _true(F.col("property_result.comparable_sale_gap_pct")
                                           > K.COMPARABLE_GAP_STRONG_GT),
        }
    )


def rule_sar_required(df: DataFrame) -> DataFrame:
    cond = _true(F.col("claim_amount") >= K.SAR_AMOUNT_MIN) & _true(F.col("risk_tier") == "HIGH")
    return df.withColumn("rule_sar_required", cond)


def rule_alta(df: DataFrame) -> DataFrame:
    """Best Practice 7 for every HIGH claim, else no practice."""
    return df.withColumn(
        "rule_alta_practices",
        F.when(_true(F.col("risk_tier") == "HIGH"), F.array(F.lit(K.ALTA_HIGH_RISK_PRACTICE)))
        .otherwise(F.array().cast("array<string>")),
    )


def state_disclosure_days(df: DataFrame, state: str = "state", out: str = "state_disclosure_days") -> DataFrame:
    return df.withColumn(out, disclosure_days(F.col(state)))


def apply_rules(df: DataFrame) -> DataFrame:
    """All claim-level rule columns at once."""
    for fn in (rule_identity_status, rule_property_status, rule_pattern_status, rule_sar_required, rule_alta,
               state_disclosure_days):
        df = fn(df)
    return df
