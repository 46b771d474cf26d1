"""Bronze operators: denormalisation of claims and the property value change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLAIMANT_ATTRIBUTES = ("state", "id_verified", "account_age_days")
PROPERTY_ATTRIBUTES = ("value_pct_change", "has_lien")


def claims_denormalise(claims: DataFrame, claimants: DataFrame, properties: DataFrame) -> DataFrame:
    """Copy claimant (state, id_verified, account_age_days) and property
    (value_pct_change, has_lien) attributes onto each claim (left joins).

    ``claims`` carries claim_id, claimant_id, property_id and the claim-only
    columns.  Join strategy is left to Spark/AQE: each dimension is broadcast
    only when its measured size is under ``spark.sql.autoBroadcastJoinThreshold``,
    otherwise sort-merge; a hot claimant/property key is split by AQE skew join.
    The dimensions are reduced to one row per id first (deterministically:
    the greatest attribute tuple), so a duplicated id in a dimension can never
    multiply claims, and a retried task picks the same row.
    """
    cl = _one_per_key(claimants, "claimant_id", CLAIMANT_ATTRIBUTES)
    pr = _one_per_key(properties, "property_id", PROPERTY_ATTRIBUTES)
    base = claims.drop(*CLAIMANT_ATTRIBUTES, *PROPERTY_ATTRIBUTES)
    return base.join(pr, "property_id", "left").join(cl, "claimant_id", "left")


def _one_per_key(df: DataFrame, key: str, attrs: tuple[str, ...]) -> DataFrame:
    picked = df.groupBy(key).agg(F.max(F.struct(*attrs)).alias("_row"))
    return picked.select(key, *[F.col(f"_row.{a}").alias(a) for a in attrs])


def property_value_change(properties: DataFrame, out: str = "value_pct_change_calc") -> DataFrame:
    """``(current_value / value_at_closing - 1) * 100`` rounded to 2 decimals
    (NULL when the closing value is 0 or NULL)."""
    closing = F.col("value_at_closing")
    ratio = F.when(closing != 0, F.col("current_value") / closing)
    return properties.withColumn(out, F.round((ratio - 1) * 100, 2))
