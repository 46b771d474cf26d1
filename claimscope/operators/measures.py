"""Dashboard measures and visuals as aggregate operators over gold / audit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope import constants as K
from claimscope.functions.aggregates import count_if, exact_avg, money
from claimscope.operators.answers import OPEN_STATUSES, by_risk, month_of

# ---------------------------------------------------------------------------
# measures (single values; each a one-row DataFrame)
# ---------------------------------------------------------------------------


def _high() -> Column:
    return F.col("risk_tier") == "HIGH"


def _open() -> Column:
    return F.col("claim_status").isin(*OPEN_STATUSES)


def _new_alert() -> Column:
    return (F.col("primary_alert") != "NONE") & (F.col("recency_bucket") == "LAST_30D")


def open_high_count_expr() -> Column:
    return count_if(_high() & _open())


def high_exposure_expr() -> Column:
    return F.sum(F.when(_high() & _open(), money("claim_amount"))).cast("double")


def avg_high_score_expr() -> Column:
    return exact_avg(F.when(_high(), F.col("fraud_risk_score")), 3)


def new_alerts_30d_expr() -> Column:
    return count_if(_new_alert())


def avg_days_open_high_expr() -> Column:
    return F.avg(F.when(_high() & (F.col("claim_status") == "OPEN"), F.col("days_since_filed")))


def m_open_high_count(gold: DataFrame) -> DataFrame:
    return gold.agg(open_high_count_expr().alias("open_high_count"))


def m_high_exposure(gold: DataFrame) -> DataFrame:
    return gold.agg(high_exposure_expr().alias("high_exposure"))


def m_avg_high_score(gold: DataFrame) -> DataFrame:
    return gold.agg(avg_high_score_expr().alias("avg_high_score"))


def m_new_alerts_30d(gold: DataFrame) -> DataFrame:
    return gold.agg(new_alerts_30d_expr().alias("new_alerts_30d"))


def m_avg_days_open_high(gold: DataFrame) -> DataFrame:
    return gold.agg(avg_days_open_high_expr().alias("avg_days_open_high"))


def kpi_all(gold: DataFrame) -> DataFrame:
    """The five gold measures in one pass over the table."""
    return gold.agg(
        open_high_count_expr().alias("open_high_count"),
        high_exposure_expr().alias("high_exposure"),
        avg_high_score_expr().alias("avg_high_score"),
        new_alerts_30d_expr().alias("new_alerts_30d"),
        avg_days_open_high_expr().alias("avg_days_open_high"),
    )


def m_sar_count(audit: DataFrame) -> DataFrame:
    return audit.agg(count_if(F.col("sar_required") == F.lit(True)).alias("sar_count"))


def m_hold_count(audit: DataFrame) -> DataFrame:
    return audit.agg(count_if(F.col("recommended_action") == "PLACE_PAYOUT_HOLD").alias("hold_count"))


def fmt_measures(kpis: DataFrame) -> DataFrame:
    """Display strings of the KPI row: ``#,0``, ``$#,0``, ``0.000``,
    ``#,0 "days"`` and exposure as ``$#,0.0"M"``.  Values are rounded
    half-up before formatting, so no tie reaches the formatter."""
    exposure = F.col("high_exposure").cast("decimal(20,2)")
    return kpis.select(
        F.format_number(F.col("open_high_count"), 0).alias("open_high_count_fmt"),
        F.concat(F.lit("$"), F.format_number(F.round(exposure, 0), 0)).alias("high_exposure_fmt"),
        F.format_number(F.round(F.col("avg_high_score").cast("decimal(20,6)"), 3), 3).alias("avg_high_score_fmt"),
        F.format_number(F.col("new_alerts_30d"), 0).alias("new_alerts_30d_fmt"),
        F.concat(
            F.format_number(F.round(F.col("avg_days_open_high").cast("decimal(20,6)"), 0), 0), F.lit(" days")
        ).alias("avg_days_open_high_fmt"),
        F.concat(F.lit("$"), F.format_number(F.round(exposure / 1_000_000, 1), 1), F.lit("M")).alias(
            "high_exposure_m_fmt"
        ),
    )


# ---------------------------------------------------------------------------
# visuals
# ---------------------------------------------------------------------------


def v_alert_types(gold: DataFrame) -> DataFrame:
    """Claims per alert, NONE excluded."""
    return (
        gold.filter(F.col("primary_alert") != "NONE")
        .groupBy("primary_alert")
        .agg(F.count(F.lit(1)).alias("claim_count"))
    )


def v_risk_trend(gold: DataFrame) -> DataFrame:
    """Claims per filing month and tier, by month."""
    return (
        gold.groupBy(month_of().alias("month"), "risk_tier")
        .agg(F.count(F.lit(1)).alias("claim_count"))
        .orderBy("month", "risk_tier")
    )


def v_state_map(gold: DataFrame) -> DataFrame:
    """Per state: open HIGH exposure, open HIGH count, average HIGH score."""
    return gold.groupBy("state").agg(
        high_exposure_expr().alias("high_exposure"),
        open_high_count_expr().alias("open_high_count"),
        avg_high_score_expr().alias("avg_high_score"),
    )


def v_claims_by_investigator(gold: DataFrame) -> DataFrame:
    """Open claims per investigator and tier, count descending."""
    return (
        gold.filter(_open())
        .groupBy("assigned_investigator", "risk_tier")
        .agg(F.count(F.lit(1)).alias("claim_count"))
        .orderBy(F.col("claim_count").desc(), "assigned_investigator", "risk_tier")
    )


OPEN_HIGH_TABLE = (
    "claim_id", "claim_amount", "fraud_risk_score", "primary_alert",
    "assigned_investigator", "filed_date", "days_since_filed",
)


def v_open_high_table(gold: DataFrame) -> DataFrame:
    """The open HIGH claims table (7 columns), score descending."""
    return by_risk(gold.filter(_high() & _open()).select(*OPEN_HIGH_TABLE))


SLICERS = ("risk_tier", "claim_status", "recency_bucket", "assigned_investigator")


def slice_by(df: DataFrame, filters: Mapping[str, Sequence[str] | str | None] | None = None) -> DataFrame:
    """Apply optional slicer selections (column -> allowed values); an absent
    or empty selection leaves the column unfiltered."""
    for col, values in (filters or {}).items():
        if values is None:
            continue
        vals = [values] if isinstance(values, str) else list(values)
        if vals:
            df = df.filter(F.col(col).isin(*vals))
    return df


SIGNALS4 = ("sig_velocity", "sig_id_unverified", "sig_property_spike", "sig_high_value")


def v_signal_by_alert(gold: DataFrame) -> DataFrame:
    """Average of four signals per alert (NONE excluded).  Signals carry at
    most two decimals, so the means are exact."""
    return (
        gold.filter(F.col("primary_alert") != "NONE")
        .groupBy("primary_alert")
        .agg(*[exact_avg(s, 2).alias(f"avg_{s}") for s in SIGNALS4])
    )


def v_signal_share(gold: DataFrame) -> DataFrame:
    """The four average signals per alert as shares of their row total."""
    sums = {s: F.sum(F.round(F.col(s) * 100).cast("bigint")) for s in SIGNALS4}
    agg = gold.filter(F.col("primary_alert") != "NONE").groupBy("primary_alert").agg(
        *[e.alias(f"_s_{s}") for s, e in sums.items()]
    )
    total = sum((F.col(f"_s_{s}") for s in SIGNALS4), F.lit(0))
    return agg.select(
        "primary_alert",
        *[
            F.when(total != 0, F.col(f"_s_{s}").cast("double") / total).alias(f"share_{s}")
            for s in SIGNALS4
        ],
    )


def v_velocity_distribution(gold: DataFrame) -> DataFrame:
    """Claims per velocity value."""
    return gold.groupBy("claim_velocity_24mo").agg(F.count(F.lit(1)).alias("claim_count"))


def v_state_type_matrix(gold: DataFrame, types: Sequence[str] = K.CLAIM_TYPES) -> DataFrame:
    """State x claim type exposure in millions (pivot over a fixed value list,
    so the column set never depends on the data)."""
    return (
        gold.groupBy("state")
        .pivot("claim_type", list(types))
        .agg((F.sum(money("claim_amount")).cast("double") / F.lit(1_000_000.0)))
    )


CLAIM_CARD = (
    "claim_id", "claim_amount", "fraud_risk_score", "risk_tier", "primary_alert",
    "claim_status", "assigned_investigator", "filed_date",
)


def v_claim_card(gold: DataFrame, claim_id: str | None = None) -> DataFrame:
    """The detail card of one claim; without an id, of the highest-risk claim."""
    if claim_id is not None:
        return gold.filter(F.col("claim_id") == claim_id).select(*CLAIM_CARD)
    return by_risk(gold.select(*CLAIM_CARD)).limit(1)


RADAR = ("sig_velocity", "sig_id_unverified", "sig_property_spike", "sig_high_value", "sig_new_account")


def v_signal_radar(gold: DataFrame) -> DataFrame:
    """Five signals of every claim as (claim_id, signal, value) rows."""
    return gold.select("claim_id", *RADAR).unpivot("claim_id", list(RADAR), "signal", "value")


AUDIT_DETAIL = (
    "recommended_action", "composite_fraud_probability", "sar_required", "identity_status",
    "property_status", "pattern_status", "compliance_status", "investigated_at",
)


def v_audit_detail(audit: DataFrame, gold: DataFrame) -> DataFrame:
    """Audit rows with their claim's gold attributes (many audit rows to one claim)."""
    g = gold.select("claim_id", "claim_amount", "fraud_risk_score", "risk_tier", "assigned_investigator")
    a = audit.select("claim_id", *AUDIT_DETAIL)
    return a.join(g.withColumnRenamed("claim_amount", "gold_claim_amount"), "claim_id", "inner")


def v_agent_status(audit: DataFrame) -> DataFrame:
    """The four agent statuses per audited claim."""
    return audit.select("claim_id", "identity_status", "property_status", "pattern_status", "compliance_status")


def v_action_counts(audit: DataFrame) -> DataFrame:
    """Audit rows per recommended action."""
    return audit.groupBy("recommended_action").agg(F.count(F.lit(1)).alias("claim_count"))


def row_security(gold: DataFrame, user: str) -> DataFrame:
    """Only the rows assigned to ``user`` (row-level security)."""
    return gold.filter(F.col("assigned_investigator") == F.lit(user))


def row_security_session(gold: DataFrame, assignments: DataFrame) -> DataFrame:
    """Only the rows whose investigator ``assignments`` (user_name, investigator) gives to the user of
    the session that reads; none for a user without an assignment.  Repeated assignments count once,
    and claims without an investigator belong to nobody."""
    mine = assignments.filter(F.col("user_name") == F.session_user()).select(F.col("investigator").alias("assigned_investigator"))
    return gold.join(mine, "assigned_investigator", "left_semi").select(*gold.columns)


def secured_view(spark: SparkSession, view: str, gold_table: str, assignments_table: str) -> None:
    """:func:`row_security_session` as a view over two catalog tables.  The user is that of the session
    that reads the view, not of the one that made it; filters on the view reach the scan of gold."""
    names = [".".join(f"`{part}`" for part in name.split(".")) for name in (view, gold_table, assignments_table)]
    spark.sql(
        "CREATE OR REPLACE VIEW {} AS SELECT g.* FROM {} g LEFT SEMI JOIN {} a "
        "ON g.assigned_investigator = a.investigator AND a.user_name = session_user()".format(*names)
    )


def threshold_alert(gold: DataFrame, threshold: int = 0, evaluated_at=None) -> DataFrame:
    """Evaluate the open-HIGH alert once: count, threshold, fired flag."""
    from claimscope.functions.scoring import as_of_timestamp

    return gold.agg(open_high_count_expr().alias("open_high_count")).select(
        as_of_timestamp(evaluated_at).alias("evaluated_at"),
        "open_high_count",
        F.lit(threshold).alias("threshold"),
        (F.col("open_high_count") > threshold).alias("fired"),
    )


def alert_throttle(evaluations: DataFrame, ts: str = "ts", value: str = "value", threshold: float = 0,
                   period: str = "1 hour") -> DataFrame:
    """At most one alert per ``period``: the first breach (value > threshold)
    of each tumbling window, as (window_start, window_end, ts, value)."""
    breaches = evaluations.filter(F.col(value) > threshold)
    return (
        breaches.groupBy(F.window(ts, period).alias("w"))
        .agg(F.min_by(F.struct(F.col(ts).alias("ts"), F.col(value).alias("value")), F.col(ts)).alias("first"))
        .select(
            F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
            F.col("first.ts").alias("alert_ts"), F.col("first.value").alias("alert_value"),
        )
    )

