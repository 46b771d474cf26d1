"""Saved answers over the gold table (the catalogue of verified questions).

Each is a ``gold -> DataFrame`` function with its filters as parameters.
Risk-ordered results break score ties by ``claim_id`` so a LIMIT always
returns the same rows (scores are 3-decimal and tie often).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.functions.aggregates import count_if, exact_avg_round, money_sum
from claimscope.functions.scoring import as_of_date

OPEN_STATUSES = ("OPEN", "UNDER_REVIEW")
URGENT_COLUMNS = (
    "claim_id", "claimant_id", "claim_amount", "fraud_risk_score", "primary_alert",
    "assigned_investigator", "filed_date",
)


def by_risk(df: DataFrame) -> DataFrame:
    """Score descending, ties by claim id (deterministic)."""
    return df.orderBy(F.col("fraud_risk_score").desc(), F.col("claim_id").asc())


def _open(statuses: Sequence[str] = OPEN_STATUSES) -> Column:
    return F.col("claim_status").isin(*statuses)


def q_urgent_open(gold: DataFrame, limit: int = 20) -> DataFrame:
    """Most urgent open HIGH claims: top ``limit`` by score (top-k, no full sort)."""
    df = gold.filter(_open() & (F.col("risk_tier") == "HIGH")).select(*URGENT_COLUMNS)
    return by_risk(df).limit(limit)


def _exposure_by(gold: DataFrame, keys: Sequence[str], cond: Column, with_avg: bool = True) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("claim_count"), money_sum("claim_amount", 0).alias("total_exposure")]
    if with_avg:
        aggs.append(exact_avg_round("fraud_risk_score", 3).alias("avg_score"))
    return gold.filter(cond).groupBy(*keys).agg(*aggs)


def q_state_exposure(gold: DataFrame) -> DataFrame:
    """HIGH and OPEN claims per state: count, exposure, average score; by exposure."""
    cond = (F.col("risk_tier") == "HIGH") & (F.col("claim_status") == "OPEN")
    return _exposure_by(gold, ["state"], cond).orderBy(F.col("total_exposure").desc())


def q_investigator_breakdown(gold: DataFrame) -> DataFrame:
    """Open claims per investigator and tier: count and exposure."""
    return (
        _exposure_by(gold, ["assigned_investigator", "risk_tier"], _open(), with_avg=False)
        .orderBy("assigned_investigator", "risk_tier")
    )


def q_open_high_90d(gold: DataFrame) -> DataFrame:
    """Open HIGH claims filed in the last 90 days."""
    cond = (F.col("risk_tier") == "HIGH") & _open() & F.col("recency_bucket").isin("LAST_30D", "LAST_90D")
    return by_risk(gold.filter(cond).select(*URGENT_COLUMNS))


def q_repeat_claimants(gold: DataFrame, min_velocity: int = 2) -> DataFrame:
    """Claimants with velocity above ``min_velocity``: claims, max velocity,
    average score, exposure; by claims descending."""
    return (
        gold.filter(F.col("claim_velocity_24mo") > min_velocity)
        .groupBy("claimant_id")
        .agg(
            F.count(F.lit(1)).alias("total_claims"),
            F.max("claim_velocity_24mo").alias("max_velocity"),
            exact_avg_round("fraud_risk_score", 3).alias("avg_risk_score"),
            money_sum("claim_amount", 0).alias("total_exposure"),
        )
        .orderBy(F.col("total_claims").desc(), F.col("claimant_id"))
    )


def q_spike_and_unverified(gold: DataFrame, spike_pct: float = 20.0) -> DataFrame:
    """Property value spiked above ``spike_pct`` and identity unverified."""
    cond = (F.col("value_pct_change") > spike_pct) & (F.col("id_verified") == F.lit(False))
    return by_risk(
        gold.filter(cond).select(
            "claim_id", "claimant_id", "claim_amount", "fraud_risk_score", "value_pct_change",
            "id_verified", "primary_alert",
        )
    )


def q_alerts_30d(gold: DataFrame) -> DataFrame:
    """Alerts other than NONE filed in the last 30 days, per alert type."""
    cond = (F.col("primary_alert") != "NONE") & (F.col("recency_bucket") == "LAST_30D")
    return (
        gold.filter(cond)
        .groupBy("primary_alert")
        .agg(F.count(F.lit(1)).alias("alert_count"), money_sum("claim_amount", 0).alias("total_exposure"))
        .orderBy(F.col("alert_count").desc())
    )


def q_wire_vs_id(gold: DataFrame, types: Sequence[str] = ("WIRE_FRAUD", "ID_FRAUD")) -> DataFrame:
    """Average score per claim type for the given types."""
    return (
        gold.filter(F.col("claim_type").isin(*types))
        .groupBy("claim_type")
        .agg(
            F.count(F.lit(1)).alias("claim_count"),
            exact_avg_round("fraud_risk_score", 3).alias("avg_score"),
            money_sum("claim_amount", 0).alias("total_amount"),
        )
        .orderBy(F.col("avg_score").desc())
    )


def q_investigator_queue(gold: DataFrame, investigator: str) -> DataFrame:
    """One investigator's open HIGH claims by amount descending."""
    cond = (F.col("assigned_investigator") == investigator) & (F.col("risk_tier") == "HIGH") & _open()
    return (
        gold.filter(cond)
        .select("claim_id", "claim_amount", "fraud_risk_score", "primary_alert", "filed_date")
        .orderBy(F.col("claim_amount").desc(), F.col("claim_id"))
    )


def month_of(col: str = "filed_date") -> Column:
    """First day of the month of a date, as DATE."""
    return F.trunc(F.col(col), "month")


def q_monthly_trend(gold: DataFrame, as_of=None, months: int = 12) -> DataFrame:
    """Claims and exposure per month and tier over the last ``months`` months."""
    since = F.add_months(as_of_date(as_of), -months)
    return (
        gold.filter(F.col("filed_date") >= since)
        .groupBy(month_of().alias("month"), "risk_tier")
        .agg(F.count(F.lit(1)).alias("claim_count"), money_sum("claim_amount", 0).alias("total_exposure"))
        .orderBy("month", "risk_tier")
    )


def q_unresolved_wire_by_state(gold: DataFrame) -> DataFrame:
    """Exposure on unresolved wire-fraud claims that raised an alert, per state."""
    cond = (
        F.col("resolved_date").isNull() & (F.col("claim_type") == "WIRE_FRAUD") & (F.col("primary_alert") != "NONE")
    )
    return (
        gold.filter(cond)
        .groupBy("state")
        .agg(F.count(F.lit(1)).alias("claim_count"), money_sum("claim_amount", 0).alias("total_exposure"))
        .orderBy(F.col("total_exposure").desc())
    )


def q_fraud_counts_two_ways(gold: DataFrame) -> DataFrame:
    """Confirmed fraud cases next to HIGH-risk flagged claims (one row)."""
    return gold.agg(
        count_if(F.col("is_confirmed_fraud")).alias("confirmed_fraud_count"),
        count_if(F.col("risk_tier") == "HIGH").alias("high_risk_flagged_count"),
    )


MANDATORY_COLUMNS = ("claim_id", "claim_amount", "fraud_risk_score", "primary_alert")


def answer_policy(
    df: DataFrame,
    columns: Sequence[str] = (),
    statuses: Sequence[str] | None = OPEN_STATUSES,
) -> DataFrame:
    """Apply the answer rules to a risk query: default status filter,
    mandatory columns first, scores rounded to 3 decimals, score descending."""
    if statuses is not None:
        if "claim_status" not in df.columns:
            raise ValueError("answer_policy filters on claim_status, which is absent; pass statuses=None for no filter")
        df = df.filter(F.col("claim_status").isin(*statuses))
    cols = list(MANDATORY_COLUMNS) + [c for c in columns if c not in MANDATORY_COLUMNS]
    out = df.select(*cols).withColumn("fraud_risk_score", F.round("fraud_risk_score", 3))
    return by_risk(out)
