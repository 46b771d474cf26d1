"""The medallion layers over a scale-factor folder, as lazy DataFrames.

``bronze -> silver -> gold`` with pinned reference dates, used by the query
catalogue, the bench and the tests.  Nothing is materialised or reused here;
the batch refresh plan (``plans.refresh``) writes each layer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimscope import constants as K
from claimscope.operators.gold import gold_select, score_claims
from claimscope.operators.silver import silver_enrich
from claimscope.sources import fixtures

def bronze_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.bronze_claims(spark, sf_dir)


def silver(spark: SparkSession, sf_dir: str, velocity_mode: str = "trailing", strategy: str = "daily") -> DataFrame:
    """``silver_enrich`` of the bronze claims.  The velocity counts the claims before the
    dimension joins (which never change their number), so bronze is evaluated once."""
    history = fixtures.claim_history(spark, sf_dir) if velocity_mode == "trailing" and strategy == "daily" else None
    return silver_enrich(bronze_claims(spark, sf_dir), K.FIXTURE_AS_OF, velocity_mode=velocity_mode, strategy=strategy, history=history)


def scored(
    spark: SparkSession,
    sf_dir: str,
    high: float = K.HIGH_THRESHOLD,
    medium: float = K.MEDIUM_THRESHOLD,
    strategy: str = "daily",
) -> DataFrame:
    """Silver + signals + score + tier + alert (all columns)."""
    return score_claims(silver(spark, sf_dir, strategy=strategy), high, medium, scored_at=K.FIXTURE_SCORED_AT)


def gold(
    spark: SparkSession,
    sf_dir: str,
    high: float = K.HIGH_THRESHOLD,
    medium: float = K.MEDIUM_THRESHOLD,
    strategy: str = "daily",
) -> DataFrame:
    """The 28-column gold table at pinned dates."""
    return gold_select(scored(spark, sf_dir, high, medium, strategy))
