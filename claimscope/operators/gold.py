"""Gold scoring: six signals, weighted score, tier, primary alert (map-only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope import constants as K
from claimscope.functions.aggregates import exact_avg_round, money_sum_millions
from claimscope.functions.scoring import (
    as_of_timestamp,
    fraud_risk_score,
    primary_alert,
    risk_tier,
    signal_columns,
)


def score_signals(silver: DataFrame) -> DataFrame:
    """Add the six signal columns."""
    return silver.withColumns(signal_columns())


def score_claims(
    silver: DataFrame,
    high: float = K.HIGH_THRESHOLD,
    medium: float = K.MEDIUM_THRESHOLD,
    weights: Sequence[float] = K.SCORE_WEIGHTS,
    scored_at=None,
) -> DataFrame:
    """Silver + signals + fraud_risk_score + risk_tier + primary_alert +
    scored_at (all columns kept).  One projection, no shuffle."""
    with_signals = score_signals(silver)
    with_score = with_signals.withColumn("fraud_risk_score", fraud_risk_score(weights))
    with_tier = with_score.withColumn("risk_tier", risk_tier("fraud_risk_score", high, medium))
    return with_tier.withColumns(
        {"primary_alert": primary_alert("risk_tier"), "scored_at": as_of_timestamp(scored_at)}
    )


def gold_select(scored: DataFrame) -> DataFrame:
    """The fixed 28-column gold contract, in order."""
    return scored.select(*K.GOLD_COLUMNS)


def gold_score(
    silver: DataFrame,
    high: float = K.HIGH_THRESHOLD,
    medium: float = K.MEDIUM_THRESHOLD,
    weights: Sequence[float] = K.SCORE_WEIGHTS,
    scored_at=None,
) -> DataFrame:
    """Silver -> gold (28 columns)."""
    return gold_select(score_claims(silver, high, medium, weights, scored_at))


def tier_summary(gold: DataFrame) -> DataFrame:
    """Per tier: claims, avg score (3 dp), exposure in millions (2 dp); by
    average score descending."""
    return (
        gold.groupBy("risk_tier")
        .agg(
            F.count(F.lit(1)).alias("claims"),
            exact_avg_round("fraud_risk_score", 3).alias("avg_score"),
            money_sum_millions("claim_amount", 2).alias("exposure_M"),
        )
        .orderBy(F.col("avg_score").desc())
    )
