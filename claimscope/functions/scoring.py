"""Column expressions of the fraud score (all built-in, codegen-friendly).

Null behaviour follows the three-valued logic of the specification:
a NULL flag/number fails every comparison and falls to the last branch,
``least(1.0, NULL)`` is 1.0, and a NULL score is tier LOW.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimscope import constants as K


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def sig_velocity(velocity: str | Column = "claim_velocity_24mo") -> Column:
    """``least(1, (velocity - 1) / 4)`` as double."""
    return F.least(F.lit(1.0), (_c(velocity) - 1).cast("double") / F.lit(4.0)).cast("double")


def sig_id_unverified(id_verified: str | Column = "id_verified") -> Column:
    """1.0 when identity is explicitly unverified (NULL -> 0.0)."""
    return F.when(_c(id_verified) == F.lit(False), F.lit(1.0)).otherwise(F.lit(0.0))


def sig_property_spike(pct: str | Column = "value_pct_change") -> Column:
    """1.0 above a 40 % rise, 0.65 above 20 %, else 0.0."""
    p = _c(pct)
    return (
        F.when(p > K.PROPERTY_SEVERE_SPIKE_PCT, F.lit(1.0))
        .when(p > K.PROPERTY_SPIKE_PCT, F.lit(0.65))
        .otherwise(F.lit(0.0))
    )


def sig_high_value(amount: str | Column = "claim_amount") -> Column:
    """1.0 above 250k, 0.55 above 100k, else 0.0."""
    a = _c(amount)
    return (
        F.when(a > K.VERY_HIGH_VALUE_AMOUNT, F.lit(1.0))
        .when(a > K.HIGH_VALUE_AMOUNT, F.lit(0.55))
        .otherwise(F.lit(0.0))
    )


def sig_new_account(age: str | Column = "account_age_days") -> Column:
    """0.8 under 180 days, 0.4 under 365 days, else 0.0."""
    a = _c(age)
    return (
        F.when(a < K.NEW_ACCOUNT_DAYS, F.lit(0.8))
        .when(a < K.YOUNG_ACCOUNT_DAYS, F.lit(0.4))
        .otherwise(F.lit(0.0))
    )


def sig_lien(has_lien: str | Column = "has_lien") -> Column:
    """0.6 when the property carries a lien (NULL -> 0.0)."""
    return F.when(_c(has_lien) == F.lit(True), F.lit(0.6)).otherwise(F.lit(0.0))


SIGNAL_COLUMNS = (
    "sig_velocity", "sig_id_unverified", "sig_property_spike",
    "sig_high_value", "sig_new_account", "sig_lien",
)


def signal_columns() -> dict[str, Column]:
    """The six signals over the silver column names."""
    return {
        "sig_velocity": sig_velocity(),
        "sig_id_unverified": sig_id_unverified(),
        "sig_property_spike": sig_property_spike(),
        "sig_high_value": sig_high_value(),
        "sig_new_account": sig_new_account(),
        "sig_lien": sig_lien(),
    }


def fraud_risk_score(
    weights: Sequence[float] = K.SCORE_WEIGHTS,
    cap: float = K.SCORE_CAP,
    signals: Sequence[str] = SIGNAL_COLUMNS,
) -> Column:
    """``round(least(cap, sum(w_i * sig_i)), 3)``, summed in signal order."""
    total = None
    for name, w in zip(signals, weights, strict=True):
        term = F.col(name) * F.lit(float(w))
        total = term if total is None else total + term
    return F.round(F.least(F.lit(float(cap)), total), 3)


def risk_tier(
    score: str | Column = "fraud_risk_score",
    high: float = K.HIGH_THRESHOLD,
    medium: float = K.MEDIUM_THRESHOLD,
) -> Column:
    """HIGH at or above ``high``, MEDIUM at or above ``medium``, else LOW."""
    s = _c(score)
    return (
        F.when(s >= F.lit(float(high)), F.lit("HIGH"))
        .when(s >= F.lit(float(medium)), F.lit("MEDIUM"))
        .otherwise(F.lit("LOW"))
    )


def primary_alert(tier: str | Column = "risk_tier") -> Column:
    """First matching rule: identity, velocity, property (HIGH/MEDIUM), multi-signal, NONE."""
    t = _c(tier)
    return (
        F.when((F.col("sig_id_unverified") >= 0.8) & (t == "HIGH"), F.lit(K.ALERT_IDENTITY))
        .when((F.col("sig_velocity") >= 0.75) & (t == "HIGH"), F.lit(K.ALERT_VELOCITY))
        .when((F.col("sig_property_spike") >= 0.65) & t.isin("HIGH", "MEDIUM"), F.lit(K.ALERT_PROPERTY))
        .when(t == "HIGH", F.lit(K.ALERT_MULTI))
        .otherwise(F.lit(K.ALERT_NONE))
    )


def recency_bucket(days: str | Column = "days_since_filed") -> Column:
    """LAST_30D / LAST_90D / LAST_YEAR by inclusive upper bound, else OLDER
    (NULL days -> OLDER, negative days -> LAST_30D)."""
    d = _c(days)
    expr = None
    for bound, label in K.RECENCY_BUCKETS:
        expr = F.when(d <= bound, F.lit(label)) if expr is None else expr.when(d <= bound, F.lit(label))
    return expr.otherwise(F.lit(K.RECENCY_OLDER))


def as_of_date(as_of) -> Column:
    """A pinned date literal, or ``current_date()`` when ``as_of`` is None."""
    return F.current_date() if as_of is None else F.lit(as_of).cast("date")


def as_of_timestamp(as_of) -> Column:
    """A pinned timestamp literal, or ``current_timestamp()`` when None."""
    return F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
