"""Hot keys: one claimant / one z-value holding a third of all rows."""

import datetime as dt

from pyspark.sql import functions as F

from claimscope.operators.silver import claim_velocity
from claimscope.plans.layout import layout_cluster


def hot_claims(spark, n=30000):
    base = dt.date(2024, 6, 30)
    return spark.range(n).select(
        F.concat(F.lit("CLM-2024-"), F.col("id").cast("string")).alias("claim_id"),
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(
            F.concat(F.lit("C"), (F.col("id") % 997).cast("string"))).alias("claimant_id"),
        F.date_sub(F.lit(base), (F.col("id") % 1500).cast("int")).alias("filed_date"),
    )


def test_hot_claimant_velocity_matches_window(spark):
    claims = hot_claims(spark)
    daily = {r.claim_id: r.claim_velocity_24mo for r in claim_velocity(claims, strategy="daily").collect()}
    window = {r.claim_id: r.claim_velocity_24mo for r in claim_velocity(claims, strategy="window").collect()}
    assert daily == window
    # the window of the daily strategy sees at most one row per claimant and day
    per_day = claims.groupBy("claimant_id", "filed_date").count()
    assert per_day.filter(F.col("claimant_id") == "HOT").count() <= 1500


def test_hot_layout_value_is_split(spark):
    df = spark.range(30000).select(
        F.concat(F.lit("c"), F.col("id").cast("string")).alias("claim_id"),
        F.when(F.col("id") % 3 == 0, F.lit(0.5)).otherwise(F.col("id") / 30000.0).alias("fraud_risk_score"),
        F.lit("LOW").alias("risk_tier"),
        F.lit(dt.date(2024, 1, 1)).alias("filed_date"),
    )
    out = layout_cluster(df, partitions=8)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 30000 and max(sizes) < 30000 / 3
