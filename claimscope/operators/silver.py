"""Silver features: velocity, value flags, recency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimscope import constants as K
from claimscope.functions.scoring import as_of_date, recency_bucket

VELOCITY_COLUMN = "claim_velocity_24mo"


def cast_filed_date(claims: DataFrame) -> DataFrame:
    """``filed_date`` as DATE (strings, timestamps and dates are accepted)."""
    return claims.withColumn("filed_date", F.to_date("filed_date"))


def claim_velocity(
    claims: DataFrame,
    days: int = K.VELOCITY_WINDOW_DAYS,
    strategy: str = "daily",
    out: str = VELOCITY_COLUMN,
    history: DataFrame | None = None,
) -> DataFrame:
    """Claims of the same claimant filed in the ``days`` days ending at each
    claim's date, same-day claims included (``count(claim_id)`` over a RANGE
    frame of ``days`` days).

    ``history`` (claim_id, claimant_id, filed_date) holds the claims that count: by
    default ``claims`` themselves.  Where ``claims`` carry joined attributes, the
    claims before those joins are the same history at the cost of three columns;
    its claimant days must cover those of ``claims`` (others count 0).

    strategy="daily" (default, skew-safe): count claims per (claimant, day)
    with map-side partial aggregation, run the RANGE window over those daily
    counts -- at most one row per claimant and calendar day, so even a claimant
    holding a third of all claims is a few thousand window rows -- and join the
    result back on (claimant, day) null-safely.  The join is one-to-one on the
    daily side, and AQE splits a hot (claimant, day) on the claims side.

    strategy="window": the direct window (one shuffle by claimant); fastest
    when no claimant is hot, but a hot claimant is a single task.
    """
    order = F.unix_date("filed_date")
    if strategy == "window" and history is None:
        w = Window.partitionBy("claimant_id").orderBy(order).rangeBetween(-days, 0)
        return claims.withColumn(out, F.count("claim_id").over(w))
    if strategy != "daily":
        raise ValueError(f"unknown velocity strategy {strategy!r}")
    velocity = daily_velocity(claims if history is None else cast_filed_date(history), days=days, out=out)
    cond = claims["claimant_id"].eqNullSafe(velocity["_v_claimant"]) & claims["filed_date"].eqNullSafe(
        velocity["_v_date"]
    )
    joined = claims.join(velocity, cond, "left").drop("_v_claimant", "_v_date")
    return joined if history is None else joined.withColumn(out, F.coalesce(out, F.lit(0).cast("bigint")))


def daily_velocity(
    claims: DataFrame,
    days: int = K.VELOCITY_WINDOW_DAYS,
    out: str = VELOCITY_COLUMN,
) -> DataFrame:
    """The velocity per (claimant, day): ``(_v_claimant, _v_date, out)``.

    Claims are counted per (claimant, day) with map-side partial aggregation
    and the RANGE window runs over those daily counts -- at most one row per
    claimant and calendar day.
    """
    daily = claims.groupBy("claimant_id", "filed_date").agg(F.count("claim_id").alias("_n"))
    w = Window.partitionBy("claimant_id").orderBy(F.unix_date("filed_date")).rangeBetween(-days, 0)
    return daily.select(
        F.col("claimant_id").alias("_v_claimant"),
        F.col("filed_date").alias("_v_date"),
        F.sum("_n").over(w).cast("bigint").alias(out),
    )


def claim_velocity_as_written(claims: DataFrame, out: str = VELOCITY_COLUMN) -> DataFrame:
    """Parity mode: what the original window degenerates to (every row of a
    claimant is a peer), i.e. the total claims of the claimant.  Computed as a
    partially-aggregated count per claimant joined back (skew-safe)."""
    totals = claims.groupBy("claimant_id").agg(F.count("claim_id").alias(out))
    totals = totals.withColumnRenamed("claimant_id", "_t_claimant")
    return claims.join(totals, claims["claimant_id"].eqNullSafe(totals["_t_claimant"]), "left").drop("_t_claimant")


def silver_columns(as_of=None) -> dict:
    """The derived silver columns other than velocity."""
    days = F.datediff(as_of_date(as_of), F.col("filed_date"))
    return {
        "is_high_value": F.col("claim_amount") > K.HIGH_VALUE_AMOUNT,
        "property_spike": F.col("value_pct_change") > K.PROPERTY_SPIKE_PCT,
        "days_since_filed": days,
        "recency_bucket": recency_bucket(days),
    }


def silver_enrich(
    claims: DataFrame,
    as_of=None,
    days: int = K.VELOCITY_WINDOW_DAYS,
    velocity_mode: str = "trailing",
    strategy: str = "daily",
    history: DataFrame | None = None,
) -> DataFrame:
    """Bronze claims -> silver: bronze columns + claim_velocity_24mo,
    is_high_value, property_spike, days_since_filed, recency_bucket.

    ``as_of`` pins the reference date (default: current date);
    ``velocity_mode`` is "trailing" (the documented 720-day window) or
    "as_written" (total claims per claimant); ``history`` as in :func:`claim_velocity`.
    """
    claims = cast_filed_date(claims)
    if velocity_mode == "trailing":
        out = claim_velocity(claims, days=days, strategy=strategy, history=history)
    elif velocity_mode == "as_written":
        out = claim_velocity_as_written(claims)
    else:
        raise ValueError(f"unknown velocity_mode {velocity_mode!r}")
    return out.withColumns(silver_columns(as_of))


def velocity_histogram(silver: DataFrame, n: int | None = 10) -> DataFrame:
    """Claims per velocity value, ascending; the first ``n`` values (the
    report shows ten) or all when ``n`` is None."""
    hist = (
        silver.groupBy(VELOCITY_COLUMN).agg(F.count(F.lit(1)).alias("count")).orderBy(VELOCITY_COLUMN)
    )
    return hist if n is None else hist.limit(n)
