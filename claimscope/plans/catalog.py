"""Query catalogue: every checked operator as ``(spark, sf_dir) -> DataFrame``
together with its independent DuckDB oracle SQL (None = rows-only check)."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from claimscope import constants as K
from claimscope.checks import oracle as O
from claimscope.operators import gold as G
from claimscope.operators import silver as S
from claimscope.plans import layers as L
from claimscope.sources import fixtures as FX

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    fn: QueryFn
    sql: str | None


CATALOG: dict[str, Entry] = {}


def register(key: str, sql: str | None):
    def deco(fn: QueryFn) -> QueryFn:
        if key in CATALOG:
            raise KeyError(f"duplicate query key {key}")
        CATALOG[key] = Entry(fn, sql)
        return fn

    return deco


# ---------------------------------------------------------------------------
# 2.2 silver features / 2.3 gold scoring (minimum slice)
# ---------------------------------------------------------------------------

_SILVER_COLS = (
    "claim_id, claimant_id, filed_date, claim_velocity_24mo, is_high_value, property_spike, "
    "days_since_filed, recency_bucket"
)


@register("silver_enrich", O.silver_sql("SELECT * EXCLUDE (k) FROM silver"))
def q_silver_enrich(spark, sf):
    # the public function on bronze, all columns; velocity counts the claims before the dimension joins
    return S.silver_enrich(FX.bronze_claims(spark, sf), as_of=K.FIXTURE_AS_OF, history=FX.claim_history(spark, sf))


@register("silver_layer", O.silver_sql(f"SELECT {_SILVER_COLS} FROM silver"))
def q_silver_layer(spark, sf):
    return L.silver(spark, sf).select(*[c.strip() for c in _SILVER_COLS.split(",")])


@register(
    "claim_velocity",
    O.silver_sql("SELECT claim_id, claimant_id, filed_date, claim_velocity_24mo FROM silver"),
)
def q_claim_velocity(spark, sf):
    claims = S.cast_filed_date(L.bronze_claims(spark, sf))
    return S.claim_velocity(claims).select("claim_id", "claimant_id", "filed_date", "claim_velocity_24mo")


@register(
    "claim_velocity_window",
    O.silver_sql("SELECT claim_id, claim_velocity_24mo FROM silver"),
)
def q_claim_velocity_window(spark, sf):
    claims = S.cast_filed_date(L.bronze_claims(spark, sf))
    return S.claim_velocity(claims, strategy="window").select("claim_id", "claim_velocity_24mo")


@register(
    "claim_velocity_as_written",
    O.silver_sql("SELECT claim_id, claim_velocity_24mo FROM silver", velocity=O.VELOCITY_AS_WRITTEN),
)
def q_claim_velocity_as_written(spark, sf):
    claims = S.cast_filed_date(L.bronze_claims(spark, sf))
    return S.claim_velocity_as_written(claims).select("claim_id", "claim_velocity_24mo")


@register("gold_score", O.gold_sql("SELECT * FROM gold"))
def q_gold_score(spark, sf):
    return L.gold(spark, sf)


@register(
    "tier_summary",
    O.gold_sql(
        f"SELECT risk_tier, count(*) AS claims, {O.avg3('fraud_risk_score')} AS avg_score, "
        f"{O.money_millions('claim_amount')} AS exposure_M FROM gold GROUP BY risk_tier ORDER BY avg_score DESC"
    ),
)
def q_tier_summary(spark, sf):
    return G.tier_summary(L.gold(spark, sf))


@register("claims_fixture", O.claims_sql("SELECT * EXCLUDE (k) FROM claims"))
def q_claims_fixture(spark, sf):
    return FX.bronze_claims(spark, sf)


# ---------------------------------------------------------------------------
# 2.1 sources (checked parts) and bronze
# ---------------------------------------------------------------------------

from pyspark.sql import functions as F  # noqa: E402

from claimscope import constants as K  # noqa: E402
from claimscope.operators import answers as A  # noqa: E402
from claimscope.operators import bronze as B  # noqa: E402
from claimscope.operators import measures as M  # noqa: E402
from claimscope.operators import quality as Q  # noqa: E402
from claimscope.sources.tables import read_table, scan_table  # noqa: E402
from claimscope.functions.choice import weighted_choice  # noqa: E402
from claimscope.plans import layout as LY  # noqa: E402
from claimscope.plans import refresh as RF  # noqa: E402
from claimscope.session import scratch_path  # noqa: E402
from claimscope.sources import landing as LD  # noqa: E402
from claimscope.sources import sinks as SK  # noqa: E402
from claimscope.streaming import scoring as ST  # noqa: E402


@register(
    "claims_denormalise",
    O.claims_sql(
        "SELECT claim_id, claimant_id, property_id, state, id_verified, account_age_days, value_pct_change, has_lien "
        "FROM claims"
    ),
)
def q_claims_denormalise(spark, sf):
    # claim-only columns of the orders, then the generic string-id denormaliser
    orders = read_table(spark, sf, "orders")
    pk = FX.order_property_keys(read_table(spark, sf, "lineitem"))
    base = FX.claim_columns(orders.join(pk, orders.o_orderkey == pk.l_orderkey, "left"))
    out = B.claims_denormalise(base, FX.claimants(spark, sf), FX.properties(spark, sf))
    return out.select(
        "claim_id", "claimant_id", "property_id", "state", "id_verified", "account_age_days",
        "value_pct_change", "has_lien",
    )


@register(
    "property_value_change",
    O.with_ctes(*O.BASE)
    + "\nSELECT property_id, value_pct_change, round((current_value / value_at_closing - 1) * 100, 2) "
    "AS value_pct_change_calc FROM properties",
)
def q_property_value_change(spark, sf):
    return B.property_value_change(FX.properties(spark, sf)).select(
        "property_id", "value_pct_change", "value_pct_change_calc"
    )


@register("src_claimants", O.with_ctes(*O.BASE) + "\nSELECT * EXCLUDE (c_custkey) FROM claimants")
def q_src_claimants(spark, sf):
    return FX.claimants(spark, sf)


@register("src_properties", O.with_ctes(*O.BASE) + "\nSELECT * EXCLUDE (p_partkey) FROM properties")
def q_src_properties(spark, sf):
    return FX.properties(spark, sf)


@register("scan_table", "SELECT * FROM customer")
def q_scan_table(spark, sf):
    return scan_table(spark, "customer", path=f"{sf}/customer.parquet")


@register("label_distribution", O.claims_sql("SELECT fraud_label, count(*) AS claim_count FROM claims GROUP BY 1"))
def q_label_distribution(spark, sf):
    return Q.label_distribution(FX.bronze_claims(spark, sf))


# ---------------------------------------------------------------------------
# 2.2 silver features, one key per feature
# ---------------------------------------------------------------------------


@register("cast_filed_date", O.claims_sql("SELECT claim_id, filed_date FROM claims"))
def q_cast_filed_date(spark, sf):
    return S.cast_filed_date(FX.bronze_claims(spark, sf)).select("claim_id", "filed_date")


@register("is_high_value", O.silver_sql("SELECT claim_id, is_high_value FROM silver"))
def q_is_high_value(spark, sf):
    return L.silver(spark, sf).select("claim_id", "is_high_value")


@register("property_spike", O.silver_sql("SELECT claim_id, property_spike FROM silver"))
def q_property_spike(spark, sf):
    return L.silver(spark, sf).select("claim_id", "property_spike")


@register("days_since_filed", O.silver_sql("SELECT claim_id, days_since_filed FROM silver"))
def q_days_since_filed(spark, sf):
    return L.silver(spark, sf).select("claim_id", "days_since_filed")


@register("recency_bucket", O.silver_sql("SELECT recency_bucket, count(*) AS claim_count FROM silver GROUP BY 1"))
def q_recency_bucket(spark, sf):
    return L.silver(spark, sf).groupBy("recency_bucket").agg(F.count(F.lit(1)).alias("claim_count"))


@register(
    "velocity_histogram",
    O.silver_sql(
        "SELECT claim_velocity_24mo, count(*) AS count FROM silver GROUP BY 1 ORDER BY 1 LIMIT 10"
    ),
)
def q_velocity_histogram(spark, sf):
    return S.velocity_histogram(L.silver(spark, sf), 10)


# ---------------------------------------------------------------------------
# 2.3 gold scoring, one key per expression
# ---------------------------------------------------------------------------

for _sig in ("sig_velocity", "sig_id_unverified", "sig_property_spike", "sig_high_value", "sig_new_account", "sig_lien"):

    def _mk(sig):
        def q(spark, sf):
            return L.scored(spark, sf).select("claim_id", sig)

        q.__name__ = f"q_{sig}"
        return q

    register(_sig, O.gold_sql(f"SELECT claim_id, {_sig} FROM scored"))(_mk(_sig))


@register("fraud_risk_score", O.gold_sql("SELECT claim_id, fraud_risk_score FROM gold"))
def q_fraud_risk_score(spark, sf):
    return L.gold(spark, sf).select("claim_id", "fraud_risk_score")


@register("risk_tier", O.gold_sql("SELECT risk_tier, count(*) AS claim_count FROM gold GROUP BY 1"))
def q_risk_tier(spark, sf):
    return L.gold(spark, sf).groupBy("risk_tier").agg(F.count(F.lit(1)).alias("claim_count"))


@register("primary_alert", O.gold_sql("SELECT claim_id, risk_tier, primary_alert FROM gold"))
def q_primary_alert(spark, sf):
    return L.gold(spark, sf).select("claim_id", "risk_tier", "primary_alert")


@register(
    "primary_alert_low_threshold",
    O.gold_sql("SELECT primary_alert, risk_tier, count(*) AS claim_count FROM gold GROUP BY 1, 2", 0.30, 0.15),
)
def q_primary_alert_low_threshold(spark, sf):
    g = L.gold(spark, sf, high=K.LOW_HIGH_THRESHOLD, medium=K.LOW_MEDIUM_THRESHOLD)
    return g.groupBy("primary_alert", "risk_tier").agg(F.count(F.lit(1)).alias("claim_count"))


@register("scored_at", O.gold_sql("SELECT claim_id, scored_at FROM gold"))
def q_scored_at(spark, sf):
    return L.gold(spark, sf).select("claim_id", "scored_at")


@register("gold_select", O.gold_sql("SELECT * FROM gold"))
def q_gold_select(spark, sf):
    return G.gold_select(L.scored(spark, sf))


# ---------------------------------------------------------------------------
# 2.5 saved answers
# ---------------------------------------------------------------------------

_URG = "claim_id, claimant_id, claim_amount, fraud_risk_score, primary_alert, assigned_investigator, filed_date"
_OPEN = "claim_status IN ('OPEN', 'UNDER_REVIEW')"


@register(
    "q_urgent_open",
    O.gold_sql(f"SELECT {_URG} FROM gold WHERE {_OPEN} AND risk_tier = 'HIGH' "
               "ORDER BY fraud_risk_score DESC, claim_id LIMIT 20"),
)
def q_urgent_open(spark, sf):
    return A.q_urgent_open(L.gold(spark, sf))


@register(
    "q_state_exposure",
    O.gold_sql(
        f"SELECT state, count(*) AS claim_count, {O.money_sum('claim_amount', 0)} AS total_exposure, "
        f"{O.avg3('fraud_risk_score')} AS avg_score FROM gold WHERE risk_tier = 'HIGH' AND claim_status = 'OPEN' "
        "GROUP BY state ORDER BY total_exposure DESC"
    ),
)
def q_state_exposure(spark, sf):
    return A.q_state_exposure(L.gold(spark, sf))


@register(
    "q_investigator_breakdown",
    O.gold_sql(
        f"SELECT assigned_investigator, risk_tier, count(*) AS claim_count, {O.money_sum('claim_amount', 0)} "
        f"AS total_exposure FROM gold WHERE {_OPEN} GROUP BY 1, 2 ORDER BY 1, 2"
    ),
)
def q_investigator_breakdown(spark, sf):
    return A.q_investigator_breakdown(L.gold(spark, sf))


@register(
    "q_open_high_90d",
    O.gold_sql(f"SELECT {_URG} FROM gold WHERE risk_tier = 'HIGH' AND {_OPEN} "
               "AND recency_bucket IN ('LAST_30D', 'LAST_90D') ORDER BY fraud_risk_score DESC"),
)
def q_open_high_90d(spark, sf):
    return A.q_open_high_90d(L.gold(spark, sf))


@register(
    "q_repeat_claimants",
    O.gold_sql(
        f"SELECT claimant_id, count(*) AS total_claims, max(claim_velocity_24mo) AS max_velocity, "
        f"{O.avg3('fraud_risk_score')} AS avg_risk_score, {O.money_sum('claim_amount', 0)} AS total_exposure "
        "FROM gold WHERE claim_velocity_24mo > 2 GROUP BY claimant_id ORDER BY total_claims DESC"
    ),
)
def q_repeat_claimants(spark, sf):
    return A.q_repeat_claimants(L.gold(spark, sf))


@register(
    "q_spike_and_unverified",
    O.gold_sql("SELECT claim_id, claimant_id, claim_amount, fraud_risk_score, value_pct_change, id_verified, "
               "primary_alert FROM gold WHERE value_pct_change > 20 AND id_verified = FALSE "
               "ORDER BY fraud_risk_score DESC"),
)
def q_spike_and_unverified(spark, sf):
    return A.q_spike_and_unverified(L.gold(spark, sf))


@register(
    "q_alerts_30d",
    O.gold_sql(
        f"SELECT primary_alert, count(*) AS alert_count, {O.money_sum('claim_amount', 0)} AS total_exposure "
        "FROM gold WHERE primary_alert != 'NONE' AND recency_bucket = 'LAST_30D' GROUP BY 1 ORDER BY 2 DESC"
    ),
)
def q_alerts_30d(spark, sf):
    return A.q_alerts_30d(L.gold(spark, sf))


@register(
    "q_wire_vs_id",
    O.gold_sql(
        f"SELECT claim_type, count(*) AS claim_count, {O.avg3('fraud_risk_score')} AS avg_score, "
        f"{O.money_sum('claim_amount', 0)} AS total_amount FROM gold "
        "WHERE claim_type IN ('WIRE_FRAUD', 'ID_FRAUD') GROUP BY 1 ORDER BY avg_score DESC"
    ),
)
def q_wire_vs_id(spark, sf):
    return A.q_wire_vs_id(L.gold(spark, sf))


@register(
    "q_investigator_queue",
    O.gold_sql(f"SELECT claim_id, claim_amount, fraud_risk_score, primary_alert, filed_date FROM gold "
               f"WHERE assigned_investigator = 'J.Rivera' AND risk_tier = 'HIGH' AND {_OPEN} "
               "ORDER BY claim_amount DESC"),
)
def q_investigator_queue(spark, sf):
    return A.q_investigator_queue(L.gold(spark, sf), "J.Rivera")


@register(
    "q_monthly_trend",
    O.gold_sql(
        f"SELECT cast(date_trunc('month', filed_date) AS date) AS month, risk_tier, count(*) AS claim_count, "
        f"{O.money_sum('claim_amount', 0)} AS total_exposure FROM gold "
        f"WHERE filed_date >= cast({O.AS_OF} - INTERVAL 12 MONTH AS date) GROUP BY 1, 2 ORDER BY 1, 2"
    ),
)
def q_monthly_trend(spark, sf):
    return A.q_monthly_trend(L.gold(spark, sf), as_of=K.FIXTURE_AS_OF)


@register(
    "q_unresolved_wire_by_state",
    O.gold_sql(
        f"SELECT state, count(*) AS claim_count, {O.money_sum('claim_amount', 0)} AS total_exposure FROM gold "
        "WHERE resolved_date IS NULL AND claim_type = 'WIRE_FRAUD' AND primary_alert <> 'NONE' "
        "GROUP BY state ORDER BY total_exposure DESC"
    ),
)
def q_unresolved_wire_by_state(spark, sf):
    return A.q_unresolved_wire_by_state(L.gold(spark, sf))


@register(
    "q_fraud_counts_two_ways",
    O.gold_sql("SELECT count(*) FILTER (WHERE is_confirmed_fraud) AS confirmed_fraud_count, "
               "count(*) FILTER (WHERE risk_tier = 'HIGH') AS high_risk_flagged_count FROM gold"),
)
def q_fraud_counts_two_ways(spark, sf):
    return A.q_fraud_counts_two_ways(L.gold(spark, sf))


@register(
    "answer_policy",
    O.gold_sql(f"SELECT claim_id, claim_amount, round(fraud_risk_score, 3) AS fraud_risk_score, primary_alert, "
               f"state, risk_tier FROM gold WHERE {_OPEN}"),
)
def q_answer_policy(spark, sf):
    return A.answer_policy(L.gold(spark, sf), columns=("state", "risk_tier"))


# ---------------------------------------------------------------------------
# 2.6 measures and visuals over gold
# ---------------------------------------------------------------------------

_HIGH_OPEN = f"risk_tier = 'HIGH' AND {_OPEN}"
_M_OPEN_HIGH = f"count(*) FILTER (WHERE {_HIGH_OPEN})"
_M_EXPOSURE = f"cast(sum(CASE WHEN {_HIGH_OPEN} THEN cast(claim_amount AS decimal(18,2)) END) AS double)"
_M_AVG_HIGH = O.avg3_raw("CASE WHEN risk_tier = 'HIGH' THEN fraud_risk_score END")
_M_ALERTS = "count(*) FILTER (WHERE primary_alert <> 'NONE' AND recency_bucket = 'LAST_30D')"
_M_DAYS = "avg(CASE WHEN risk_tier = 'HIGH' AND claim_status = 'OPEN' THEN days_since_filed END)"

for _key, _expr, _alias, _fn in (
    ("m_open_high_count", _M_OPEN_HIGH, "open_high_count", M.m_open_high_count),
    ("m_high_exposure", _M_EXPOSURE, "high_exposure", M.m_high_exposure),
    ("m_avg_high_score", _M_AVG_HIGH, "avg_high_score", M.m_avg_high_score),
    ("m_new_alerts_30d", _M_ALERTS, "new_alerts_30d", M.m_new_alerts_30d),
    ("m_avg_days_open_high", _M_DAYS, "avg_days_open_high", M.m_avg_days_open_high),
):

    def _mk_measure(fn):
        def q(spark, sf):
            return fn(L.gold(spark, sf))

        q.__name__ = f"q_{fn.__name__}"
        return q

    register(_key, O.gold_sql(f"SELECT {_expr} AS {_alias} FROM gold"))(_mk_measure(_fn))

_KPI_SQL = (
    f"SELECT {_M_OPEN_HIGH} AS open_high_count, {_M_EXPOSURE} AS high_exposure, {_M_AVG_HIGH} AS avg_high_score, "
    f"{_M_ALERTS} AS new_alerts_30d, {_M_DAYS} AS avg_days_open_high FROM gold"
)


@register("kpi_all", O.gold_sql(_KPI_SQL))
def q_kpi_all(spark, sf):
    return M.kpi_all(L.gold(spark, sf))


@register(
    "fmt_measures",
    O.gold_sql(
        "SELECT format('{:,}', open_high_count) AS open_high_count_fmt, "
        "'$' || format('{:,}', cast(round(cast(high_exposure AS decimal(20,2)), 0) AS bigint)) AS high_exposure_fmt, "
        "printf('%.3f', round(cast(avg_high_score AS decimal(20,6)), 3)) AS avg_high_score_fmt, "
        "format('{:,}', new_alerts_30d) AS new_alerts_30d_fmt, "
        "format('{:,}', cast(round(cast(avg_days_open_high AS decimal(20,6)), 0) AS bigint)) || ' days' "
        "AS avg_days_open_high_fmt, "
        "'$' || format('{:,.1f}', round(cast(high_exposure AS decimal(20,2)) / 1000000, 1)) || 'M' "
        "AS high_exposure_m_fmt "
        f"FROM ({_KPI_SQL}) kpis"
    ),
)
def q_fmt_measures(spark, sf):
    return M.fmt_measures(M.kpi_all(L.gold(spark, sf)))


@register(
    "v_alert_types",
    O.gold_sql("SELECT primary_alert, count(*) AS claim_count FROM gold WHERE primary_alert != 'NONE' GROUP BY 1"),
)
def q_v_alert_types(spark, sf):
    return M.v_alert_types(L.gold(spark, sf))


@register(
    "v_risk_trend",
    O.gold_sql("SELECT cast(date_trunc('month', filed_date) AS date) AS month, risk_tier, count(*) AS claim_count "
               "FROM gold GROUP BY 1, 2 ORDER BY 1, 2"),
)
def q_v_risk_trend(spark, sf):
    return M.v_risk_trend(L.gold(spark, sf))


@register(
    "v_state_map",
    O.gold_sql(f"SELECT state, {_M_EXPOSURE} AS high_exposure, {_M_OPEN_HIGH} AS open_high_count, "
               f"{_M_AVG_HIGH} AS avg_high_score FROM gold GROUP BY state"),
)
def q_v_state_map(spark, sf):
    return M.v_state_map(L.gold(spark, sf))


@register(
    "v_claims_by_investigator",
    O.gold_sql(f"SELECT assigned_investigator, risk_tier, count(*) AS claim_count FROM gold WHERE {_OPEN} "
               "GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2"),
)
def q_v_claims_by_investigator(spark, sf):
    return M.v_claims_by_investigator(L.gold(spark, sf))


@register(
    "v_open_high_table",
    O.gold_sql("SELECT claim_id, claim_amount, fraud_risk_score, primary_alert, assigned_investigator, filed_date, "
               f"days_since_filed FROM gold WHERE {_HIGH_OPEN} ORDER BY fraud_risk_score DESC"),
)
def q_v_open_high_table(spark, sf):
    return M.v_open_high_table(L.gold(spark, sf))


@register(
    "slice_by",
    O.gold_sql("SELECT claim_id, risk_tier, claim_status, recency_bucket, assigned_investigator FROM gold "
               "WHERE risk_tier IN ('HIGH', 'MEDIUM') AND claim_status = 'OPEN' "
               "AND assigned_investigator IN ('M.Chen', 'S.Patel')"),
)
def q_slice_by(spark, sf):
    g = L.gold(spark, sf).select("claim_id", "risk_tier", "claim_status", "recency_bucket", "assigned_investigator")
    return M.slice_by(
        g,
        {"risk_tier": ["HIGH", "MEDIUM"], "claim_status": "OPEN", "recency_bucket": None,
         "assigned_investigator": ["M.Chen", "S.Patel"]},
    )


def _avg2(col: str) -> str:
    return f"(cast(sum(cast(round({col} * 100) AS bigint)) AS double) / (count({col}) * 100.0))"


@register(
    "v_signal_by_alert",
    O.gold_sql(
        "SELECT primary_alert, "
        + ", ".join(f"{_avg2(s)} AS avg_{s}" for s in M.SIGNALS4)
        + " FROM gold WHERE primary_alert != 'NONE' GROUP BY 1"
    ),
)
def q_v_signal_by_alert(spark, sf):
    return M.v_signal_by_alert(L.gold(spark, sf))


_SUMS = ", ".join(f"sum(cast(round({s} * 100) AS bigint)) AS s_{s}" for s in M.SIGNALS4)
_TOT = " + ".join(f"s_{s}" for s in M.SIGNALS4)


@register(
    "v_signal_share",
    O.gold_sql(
        "SELECT primary_alert, "
        + ", ".join(f"CASE WHEN ({_TOT}) <> 0 THEN cast(s_{s} AS double) / ({_TOT}) END AS share_{s}"
                    for s in M.SIGNALS4)
        + f" FROM (SELECT primary_alert, {_SUMS} FROM gold WHERE primary_alert != 'NONE' GROUP BY 1) t"
    ),
)
def q_v_signal_share(spark, sf):
    return M.v_signal_share(L.gold(spark, sf))


@register(
    "v_velocity_distribution",
    O.gold_sql("SELECT claim_velocity_24mo, count(*) AS claim_count FROM gold GROUP BY 1"),
)
def q_v_velocity_distribution(spark, sf):
    return M.v_velocity_distribution(L.gold(spark, sf))


@register(
    "v_state_type_matrix",
    O.gold_sql(
        "SELECT state, "
        + ", ".join(
            f"cast(sum(CASE WHEN claim_type = '{t}' THEN cast(claim_amount AS decimal(18,2)) END) AS double) "
            f"/ 1000000.0 AS {t}"
            for t in K.CLAIM_TYPES
        )
        + " FROM gold GROUP BY state"
    ),
)
def q_v_state_type_matrix(spark, sf):
    return M.v_state_type_matrix(L.gold(spark, sf))


@register(
    "v_claim_card",
    O.gold_sql("SELECT claim_id, claim_amount, fraud_risk_score, risk_tier, primary_alert, claim_status, "
               "assigned_investigator, filed_date FROM gold ORDER BY fraud_risk_score DESC, claim_id LIMIT 1"),
)
def q_v_claim_card(spark, sf):
    return M.v_claim_card(L.gold(spark, sf))


@register(
    "v_signal_radar",
    O.gold_sql(
        " UNION ALL ".join(f"SELECT claim_id, '{s}' AS signal, {s} AS value FROM gold" for s in M.RADAR)
    ),
)
def q_v_signal_radar(spark, sf):
    return M.v_signal_radar(L.gold(spark, sf))


@register(
    "row_security",
    O.gold_sql("SELECT claim_id, assigned_investigator, risk_tier FROM gold WHERE assigned_investigator = 'K.Thomas'"),
)
def q_row_security(spark, sf):
    return M.row_security(L.gold(spark, sf), "K.Thomas").select("claim_id", "assigned_investigator", "risk_tier")


@register(
    "threshold_alert",
    O.gold_sql(f"SELECT {O.SCORED_AT} AS evaluated_at, {_M_OPEN_HIGH} AS open_high_count, 0 AS threshold, "
               f"{_M_OPEN_HIGH} > 0 AS fired FROM gold"),
)
def q_threshold_alert(spark, sf):
    return M.threshold_alert(L.gold(spark, sf), 0, evaluated_at=K.FIXTURE_SCORED_AT)


# ---------------------------------------------------------------------------
# 2.7 data quality
# ---------------------------------------------------------------------------


def _layer_tables(spark, sf):
    silver = L.silver(spark, sf)
    return {
        "bronze_claims_raw": FX.bronze_claims(spark, sf),
        "bronze_claimants": FX.claimants(spark, sf),
        "bronze_properties": FX.properties(spark, sf),
        "silver_claims_enriched": silver,
        "gold_claims_fraud_scored": L.gold(spark, sf),
    }


_COUNTS_SQL = (
    "SELECT 'bronze_claims_raw' AS table_name, (SELECT count(*) FROM claims) AS row_count, 1000 AS lo, 2000 AS hi "
    "UNION ALL SELECT 'bronze_claimants', (SELECT count(*) FROM claimants), 300, 500 "
    "UNION ALL SELECT 'bronze_properties', (SELECT count(*) FROM properties), 600, 1000 "
    "UNION ALL SELECT 'silver_claims_enriched', (SELECT count(*) FROM silver), 1000, 2000 "
    "UNION ALL SELECT 'gold_claims_fraud_scored', (SELECT count(*) FROM gold), 1000, 2000"
)


@register(
    "dq_row_count_range",
    O.gold_sql(f"SELECT *, coalesce(row_count >= lo AND row_count <= hi, false) AS passed FROM ({_COUNTS_SQL}) t"),
)
def q_dq_row_count_range(spark, sf):
    return Q.dq_row_count_range(_layer_tables(spark, sf))


_STATS_SQL = (
    f"SELECT min(fraud_risk_score) AS min_score, max(fraud_risk_score) AS max_score, "
    f"{O.avg3_raw('fraud_risk_score')} AS avg_score, count(*) FILTER (WHERE risk_tier = 'HIGH') AS high_count, "
    "count(*) FILTER (WHERE risk_tier = 'MEDIUM') AS med_count, count(*) AS total FROM gold"
)


@register("dq_score_stats", O.gold_sql(_STATS_SQL))
def q_dq_score_stats(spark, sf):
    return Q.dq_score_stats(L.gold(spark, sf))


@register(
    "dq_score_checks",
    O.gold_sql(
        "SELECT coalesce(min_score >= 0 AND max_score <= 1, false) AS score_range_ok, "
        "coalesce(high_count >= 0.05 * total AND total > 0, false) AS high_share_ok, "
        "med_count > 0 AS medium_populated, min_score, max_score, high_count, med_count, total "
        f"FROM ({_STATS_SQL}) s"
    ),
)
def q_dq_score_checks(spark, sf):
    return Q.dq_score_checks(L.gold(spark, sf))


@register(
    "dq_null_counts",
    O.gold_sql(
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count FROM gold"
            for c in K.DQ_NOT_NULL_COLUMNS
        )
    ),
)
def q_dq_null_counts(spark, sf):
    return Q.dq_null_counts(L.gold(spark, sf))


@register(
    "dq_velocity_max",
    O.gold_sql("SELECT max(claim_velocity_24mo) AS max_velocity, coalesce(max(claim_velocity_24mo) > 1, false) "
               "AS passed FROM gold"),
)
def q_dq_velocity_max(spark, sf):
    return Q.dq_velocity_max(L.gold(spark, sf))


def _dq_report_sql() -> str:
    counts = (
        "SELECT 'row_counts' AS section, table_name AS \"check\", coalesce(row_count >= lo AND row_count <= hi, false) "
        "AS passed, format('{:,}', row_count) || ' rows' AS detail FROM (" + _COUNTS_SQL + ") c"
    )
    schema = " UNION ALL ".join(
        f"SELECT 'schema', 'column {c}', true, NULL" for c in K.DQ_REQUIRED_GOLD_COLUMNS
    )
    stats = (
        "SELECT 'score_distribution', 'score range 0-1', coalesce(min_score >= 0 AND max_score <= 1, false), "
        "'min=' || printf('%.3f', round(cast(min_score AS decimal(20,6)), 3)) || ' max=' || "
        "printf('%.3f', round(cast(max_score AS decimal(20,6)), 3)) FROM (" + _STATS_SQL + ") s "
        "UNION ALL SELECT 'score_distribution', 'HIGH tier share', coalesce(high_count >= 0.05 * total AND total > 0, "
        "false), cast(high_count AS varchar) || '/' || cast(total AS varchar) FROM (" + _STATS_SQL + ") s "
        "UNION ALL SELECT 'score_distribution', 'MEDIUM tier populated', med_count > 0, "
        "cast(med_count AS varchar) || ' claims' FROM (" + _STATS_SQL + ") s"
    )
    nulls = " UNION ALL ".join(
        f"SELECT 'nulls', 'no NULLs in {c}', count(*) FILTER (WHERE {c} IS NULL) = 0, "
        f"cast(count(*) FILTER (WHERE {c} IS NULL) AS varchar) || ' NULLs' FROM gold"
        for c in K.DQ_NOT_NULL_COLUMNS
    )
    vel = (
        "SELECT 'velocity', 'velocity above 1 exists', coalesce(max(claim_velocity_24mo) > 1, false), "
        "'max velocity = ' || cast(max(claim_velocity_24mo) AS varchar) FROM gold"
    )
    return O.gold_sql(" UNION ALL ".join([counts, schema, stats, nulls, vel]))


@register("dq_report", _dq_report_sql())
def q_dq_report(spark, sf):
    return Q.dq_report(_layer_tables(spark, sf))


@register(
    "dq_summary",
    "SELECT count(*) FILTER (WHERE passed) AS passed_checks, count(*) FILTER (WHERE NOT passed) AS failed_checks "
    f"FROM ({_dq_report_sql()}) r",
)
def q_dq_summary(spark, sf):
    return Q.dq_summary(Q.dq_report(_layer_tables(spark, sf)))


# ---------------------------------------------------------------------------
# 2.4 investigation queue, validation, requests, rules, replies, decision
# ---------------------------------------------------------------------------

from claimscope.checks import oracle_replies as OR  # noqa: E402
from claimscope.operators import queue as QU  # noqa: E402
from claimscope.operators import replies as RE  # noqa: E402
from claimscope.operators import report as RP  # noqa: E402
from claimscope.operators import requests as RQ  # noqa: E402
from claimscope.operators import rules as RU  # noqa: E402
from claimscope.plans import investigate as INV  # noqa: E402

_QCOLS = ", ".join(K.QUEUE_COLUMNS)
_QWHERE = OR.QUEUE_WHERE.format(min_amount=50000.0)
PRIOR_RUN_MIN_AMOUNT = 200000.0


def _replies(spark, sf):
    return FX.agent_replies(spark, sf)


def _investigation(spark, sf, min_amount=K.ALERT_AMOUNT_MIN, audit_log=None):
    return INV.investigate(L.gold(spark, sf), _replies(spark, sf), min_amount=min_amount, audit_log=audit_log,
                           investigated_at=K.FIXTURE_SCORED_AT)


@register("pending_queue", O.gold_sql(f"SELECT {_QCOLS} FROM gold WHERE {_QWHERE} ORDER BY fraud_risk_score DESC"))
def q_pending_queue(spark, sf):
    return QU.pending_queue(L.gold(spark, sf))


@register(
    "pending_queue_new_only",
    OR.audit_sql(f"SELECT {_QCOLS} FROM gold WHERE {_QWHERE} AND claim_id NOT IN (SELECT claim_id FROM audit)",
                 min_amount=PRIOR_RUN_MIN_AMOUNT),
)
def q_pending_queue_new_only(spark, sf):
    # the audit log of an earlier run that only took claims of 200k and more
    prior = _investigation(spark, sf, min_amount=PRIOR_RUN_MIN_AMOUNT).audit
    return QU.pending_queue(L.gold(spark, sf), audit=prior)


@register("queue_dry_run", O.gold_sql(f"SELECT claim_id FROM gold WHERE {_QWHERE}"))
def q_queue_dry_run(spark, sf):
    return QU.queue_dry_run(QU.pending_queue(L.gold(spark, sf), ordered=False))


@register(
    "claim_lookup",
    O.gold_sql(f"SELECT {_QCOLS} FROM gold WHERE claim_id = (SELECT claim_id FROM gold WHERE {_QWHERE} "
               "ORDER BY fraud_risk_score DESC, claim_id LIMIT 1)"),
)
def q_claim_lookup(spark, sf):
    g = L.gold(spark, sf)
    top = QU.pending_queue(g).limit(1).select("claim_id")
    return QU.claim_lookup(g, top)


#: The claim of order 1, whatever its year; literal ids are what a look-up gets.
_CLAIM_IDS = tuple(f"CLM-{y}-7001" for y in range(1992, 2003))


def _point(fn):
    """``fn`` of each literal id over a gold table written for look-ups (bloom filters on claim_id)."""

    def q(spark, sf):
        path = scratch_path(spark, f"q-lookup-{uuid.uuid4().hex[:10]}")
        SK.sink_overwrite(LY.layout_cluster(L.gold(spark, sf)), path, lookup=("claim_id",))
        gold = scan_table(spark, "gold", path)
        out = fn(gold, _CLAIM_IDS[0])
        for claim_id in _CLAIM_IDS[1:]:
            out = out.unionByName(fn(gold, claim_id))
        return out

    return q


register("claim_lookup_by_id", O.gold_sql(f"SELECT {_QCOLS} FROM gold WHERE claim_id IN {_CLAIM_IDS}"))(_point(QU.claim_lookup))
register("v_claim_card_by_id", O.gold_sql("SELECT claim_id, claim_amount, fraud_risk_score, risk_tier, primary_alert, claim_status, "
         f"assigned_investigator, filed_date FROM gold WHERE claim_id IN {_CLAIM_IDS}"))(_point(M.v_claim_card))


_VIOL = (
    "concat_ws('|', "
    "case when NOT coalesce(regexp_full_match(claim_id, 'CLM-[0-9]{4}-[0-9]+'), false) then 'claim_id_pattern' end, "
    "case when claimant_id IS NULL then 'claimant_id_missing' end, "
    "case when property_id IS NULL then 'property_id_missing' end, "
    "case when NOT coalesce(claim_amount > 0, false) then 'claim_amount_not_positive' end, "
    "case when NOT coalesce(fraud_risk_score >= 0 AND fraud_risk_score <= 1, false) then 'fraud_risk_score_range' end, "
    "case when NOT coalesce(risk_tier IN ('HIGH', 'MEDIUM', 'LOW'), false) then 'risk_tier_domain' end, "
    "case when primary_alert IS NULL then 'primary_alert_missing' end, "
    "case when NOT coalesce(length(state) = 2, false) then 'state_length' end, "
    "case when claim_type IS NULL then 'claim_type_missing' end, "
    "case when id_verified IS NULL then 'id_verified_missing' end, "
    "case when value_pct_change IS NULL then 'value_pct_change_missing' end, "
    "case when NOT coalesce(claim_velocity_24mo >= 0, false) then 'claim_velocity_negative' end, "
    "case when has_lien IS NULL then 'has_lien_missing' end, "
    "case when NOT coalesce(account_age_days >= 0, false) then 'account_age_negative' end, "
    "case when assigned_investigator IS NULL then 'assigned_investigator_missing' end)"
)


@register(
    "claim_validate",
    O.gold_sql(f"SELECT claim_id, {_VIOL} = '' AS is_valid, {_VIOL} AS violations, "
               f"CASE WHEN {_VIOL} = '' THEN upper(state) ELSE state END AS state FROM gold"),
)
def q_claim_validate(spark, sf):
    v = QU.claim_validate(L.gold(spark, sf).select(*K.QUEUE_COLUMNS))
    return v.select("claim_id", "is_valid", F.array_join("violations", "|").alias("violations"), "state")


_REQ_TYPES = {
    "claim_id": "string", "id_verified": "boolean", "account_age_days": "bigint", "claim_velocity_24mo": "bigint",
    "state": "string", "claim_amount": "double", "claimant_id": "string", "property_id": "string",
    "value_pct_change": "double", "has_lien": "boolean", "claim_type": "string", "fraud_risk_score": "double",
    "primary_alert": "string", "risk_tier": "string", "state_disclosure_days": "int",
}

for _agent in RQ.REQUEST_FIELDS:

    def _mk_req(agent):
        fields = RQ.REQUEST_FIELDS[agent]
        schema = ", ".join(f"{f} {_REQ_TYPES[f]}" for f in fields)

        def q(spark, sf):
            g = L.gold(spark, sf)
            req = g.select(RQ.request_json(agent).alias("request"))
            return req.select(F.from_json("request", schema).alias("p")).select("p.*")

        q.__name__ = f"q_agent_request_{agent}"
        return q

    _fields = RQ.REQUEST_FIELDS[_agent]
    _sel = ", ".join(
        f"cast({OR.DISCLOSURE} AS integer) AS state_disclosure_days" if f == "state_disclosure_days" else f
        for f in _fields
    )
    _key = "agent_request_pattern" if _agent == "claims_pattern" else f"agent_request_{_agent}"
    register(_key, O.gold_sql(f"SELECT {_sel} FROM gold"))(_mk_req(_agent))


@register(
    "rule_identity_status",
    O.gold_sql("SELECT claim_id, CASE WHEN coalesce(id_verified = false, false) OR coalesce(account_age_days < 180, "
               "false) OR coalesce(claim_velocity_24mo > 3, false) THEN 'FLAGGED' ELSE 'CLEAR' END "
               "AS rule_identity_status FROM gold"),
)
def q_rule_identity_status(spark, sf):
    return RU.rule_identity_status(L.gold(spark, sf)).select("claim_id", "rule_identity_status")


@register(
    "rule_property_status",
    O.gold_sql("SELECT claim_id, CASE WHEN coalesce(value_pct_change > 20, false) OR coalesce(has_lien = true, false) "
               "THEN 'ANOMALY_DETECTED' ELSE 'CLEAR' END AS rule_property_status FROM gold"),
)
def q_rule_property_status(spark, sf):
    return RU.rule_property_status(L.gold(spark, sf)).select("claim_id", "rule_property_status")


@register(
    "rule_pattern_status",
    O.gold_sql("SELECT claim_id, CASE WHEN coalesce(claim_velocity_24mo > 2, false) OR coalesce(fraud_risk_score > "
               "0.75, false) THEN 'MATCH_FOUND' ELSE 'CLEAR' END AS rule_pattern_status FROM gold"),
)
def q_rule_pattern_status(spark, sf):
    return RU.rule_pattern_status(L.gold(spark, sf)).select("claim_id", "rule_pattern_status")


@register(
    "rule_sar_required",
    O.gold_sql("SELECT claim_id, coalesce(claim_amount >= 5000, false) AND coalesce(risk_tier = 'HIGH', false) "
               "AS rule_sar_required FROM gold"),
)
def q_rule_sar_required(spark, sf):
    return RU.rule_sar_required(L.gold(spark, sf)).select("claim_id", "rule_sar_required")


@register(
    "rule_alta",
    O.gold_sql("SELECT claim_id, CASE WHEN risk_tier = 'HIGH' THEN '7' ELSE '' END AS rule_alta_practices FROM gold"),
)
def q_rule_alta(spark, sf):
    r = RU.rule_alta(L.gold(spark, sf))
    return r.select("claim_id", F.array_join("rule_alta_practices", "|").alias("rule_alta_practices"))


@register(
    "state_disclosure_days",
    O.gold_sql(f"SELECT claim_id, state, cast({OR.DISCLOSURE} AS integer) AS state_disclosure_days FROM gold"),
)
def q_state_disclosure_days(spark, sf):
    return RU.state_disclosure_days(L.gold(spark, sf)).select("claim_id", "state", "state_disclosure_days")


@register(
    "reply_select",
    "SELECT c.conv_id AS thread_id, coalesce(a.t, '{}') AS raw_response FROM (SELECT DISTINCT conv_id FROM "
    "conversations) c LEFT JOIN (SELECT conv_id, arg_min(text, turn) AS t FROM conversations WHERE role = 'assistant' "
    "GROUP BY conv_id) a ON c.conv_id = a.conv_id",
)
def q_reply_select(spark, sf):
    return RE.reply_select(FX.threads(spark, sf))


_LISTS = {"findings", "id_doc_issues", "shared_identifiers", "alta_practices_triggered", "regulatory_notes"}

for _agent in K.AGENTS:

    def _mk_parse(agent):
        names = [f.name for f in RE.AGENT_FIELDS[agent]]

        def q(spark, sf):
            p = RE.reply_parse(_replies(spark, sf), agent, claims=L.gold(spark, sf))
            cols = [
                F.array_join(f"result.{n}", "|").alias(n) if n in _LISTS else F.col(f"result.{n}").alias(n)
                for n in names
            ]
            return p.select("claim_id", *cols, F.col("result.error_reason").alias("error_reason"))

        q.__name__ = f"q_reply_parse_{agent}"
        return q

    _cols = ", ".join(OR.parsed_columns(_agent, "raw_response", ""))
    _sql = OR.claims_with_replies(
        f"SELECT g.claim_id, {_cols} FROM gold g LEFT JOIN (SELECT claim_id, arg_min(raw_response, turn) AS raw_response "
        f"FROM replies WHERE agent = '{_agent}' AND raw_response IS NOT NULL GROUP BY claim_id) r ON r.claim_id = g.claim_id"
    )
    _key = "reply_parse_pattern" if _agent == "claims_pattern" else f"reply_parse_{_agent}"
    register(_key, _sql)(_mk_parse(_agent))


def _parsed_all(spark, sf):
    return INV.parse_all_claims(L.gold(spark, sf), _replies(spark, sf))


_ALL_SRC = "(SELECT g.*, cr.* EXCLUDE (claim_id) FROM gold g LEFT JOIN claim_replies cr ON g.claim_id = cr.claim_id) s"


@register(
    "repeated_replies",
    OR.claims_with_replies(
        "SELECT claim_id, agent, raw_response, reply_number FROM (SELECT *, row_number() OVER (PARTITION BY claim_id, agent "
        "ORDER BY turn, raw_response) AS reply_number FROM replies WHERE raw_response IS NOT NULL) n WHERE reply_number > 1"
    ),
)
def q_repeated_replies(spark, sf):
    return RE.repeated_replies(_replies(spark, sf)).select("claim_id", "agent", "raw_response", "reply_number")


def _decided_sql(select: str) -> str:
    return OR.claims_with_replies(f"SELECT {select} FROM ({OR.decision_sql(OR.parsed_all_sql(_ALL_SRC))}) d")


_ERR_SQL = " UNION ALL ".join(
    f"SELECT claim_id, '{OR.DISPLAY[a]}' AS agent_name, {a}_error_reason AS error_reason, {a}_findings AS finding "
    f"FROM ({OR.parsed_all_sql(_ALL_SRC)}) p WHERE {a}_status = 'ERROR'"
    for a in K.AGENTS
)


@register("reply_error_rows", OR.claims_with_replies(_ERR_SQL))
def q_reply_error_rows(spark, sf):
    return RE.reply_error_rows(_parsed_all(spark, sf))


@register(
    "agents_pivot",
    _decided_sql(", ".join(f"{a}_status, {a}_risk_delta" for a in K.AGENTS) + ", claim_id"),
)
def q_agents_pivot(spark, sf):
    p = _parsed_all(spark, sf)
    cols = []
    for a, c in RE.RESULT_COLUMNS.items():
        cols += [F.col(f"{c}.status").alias(f"{a}_status"), F.col(f"{c}.risk_delta").alias(f"{a}_risk_delta")]
    return p.select("claim_id", *cols)


@register("flagged_count", _decided_sql("claim_id, flagged_count"))
def q_flagged_count(spark, sf):
    return _parsed_all(spark, sf).select("claim_id", "flagged_count")


@register("composite_fallback", _decided_sql("claim_id, fallback_probability"))
def q_composite_fallback(spark, sf):
    return _parsed_all(spark, sf).select("claim_id", "fallback_probability")


@register("decision_fallback", _decided_sql("claim_id, fallback_action"))
def q_decision_fallback(spark, sf):
    return _parsed_all(spark, sf).select("claim_id", "fallback_action")


@register("rationale_fallback", _decided_sql("claim_id, fallback_rationale"))
def q_rationale_fallback(spark, sf):
    return _parsed_all(spark, sf).select("claim_id", "fallback_rationale")


@register(
    "synthesis_parse",
    _decided_sql("claim_id, composite_fraud_probability, recommended_action, action_rationale, used_fallback, "
                 "quarantine_reason"),
)
def q_synthesis_parse(spark, sf):
    return _parsed_all(spark, sf).select(
        "claim_id", "composite_fraud_probability", "recommended_action", "action_rationale", "used_fallback",
        "quarantine_reason",
    )


@register(
    "rule_strong_signals",
    _decided_sql("claim_id, coalesce(claims_pattern_cohort_similarity_pct > 70, false) AS strong_cohort_match, "
                 "coalesce(property_title_transfers_24mo > 2, false) AS strong_title_transfers, "
                 "coalesce(property_comparable_sale_gap_pct > 15, false) AS strong_comparable_gap"),
)
def q_rule_strong_signals(spark, sf):
    return RU.rule_strong_signals(_parsed_all(spark, sf)).select(
        "claim_id", "strong_cohort_match", "strong_title_transfers", "strong_comparable_gap"
    )


_SYN_SCHEMA = (
    "claim_id string, claim_amount double, original_score double, risk_tier string, "
    "identity struct<status string, risk_delta double, findings array<string>>, "
    "property struct<status string, risk_delta double, findings array<string>>, "
    "claims_pattern struct<status string, risk_delta double, findings array<string>>, "
    "compliance struct<status string, sar_required boolean, findings array<string>>"
)


@register(
    "synthesis_request",
    _decided_sql(
        "claim_id, claim_amount, fraud_risk_score AS original_score, risk_tier, identity_status, identity_risk_delta, "
        "identity_findings, property_status, property_risk_delta, claims_pattern_status, compliance_status, "
        "compliance_sar_required, compliance_findings"
    ),
)
def q_synthesis_request(spark, sf):
    # the payload parsed back: every field the synthesis step receives
    req = RQ.synthesis_request(_parsed_all(spark, sf))
    p = req.select(F.from_json("request", _SYN_SCHEMA).alias("p"))
    return p.select(
        "p.claim_id", "p.claim_amount", "p.original_score", "p.risk_tier",
        F.col("p.identity.status").alias("identity_status"),
        F.col("p.identity.risk_delta").alias("identity_risk_delta"),
        F.array_join("p.identity.findings", "|").alias("identity_findings"),
        F.col("p.property.status").alias("property_status"),
        F.col("p.property.risk_delta").alias("property_risk_delta"),
        F.col("p.claims_pattern.status").alias("claims_pattern_status"),
        F.col("p.compliance.status").alias("compliance_status"),
        F.col("p.compliance.sar_required").alias("compliance_sar_required"),
        F.array_join("p.compliance.findings", "|").alias("compliance_findings"),
    )


_REPORT_SQL = OR.claims_with_replies(
    f"SELECT claim_id, risk_tier, fraud_risk_score AS original_fraud_score, identity_ssn_discrepancies, "
    "identity_watchlist_match, property_value_change_pct, property_lien_count, claims_pattern_pattern_cohort, "
    "compliance_state_disclosure_days, compliance_findings, action_rationale, true AS human_review_required "
    f"FROM ({OR.decision_sql(OR.parsed_all_sql(f'({OR.queue_sql()}) q'))}) d WHERE quarantine_reason IS NULL"
)


@register("investigation_report", _REPORT_SQL)
def q_investigation_report(spark, sf):
    # the nested report, checked through a projection of its nested fields
    r = _investigation(spark, sf).report
    return r.select(
        "claim_id", "risk_tier", "original_fraud_score",
        F.col("identity_result.ssn_discrepancies").alias("identity_ssn_discrepancies"),
        F.col("identity_result.watchlist_match").alias("identity_watchlist_match"),
        F.col("property_result.value_change_pct").alias("property_value_change_pct"),
        F.col("property_result.lien_count").alias("property_lien_count"),
        F.col("claims_pattern_result.pattern_cohort").alias("claims_pattern_pattern_cohort"),
        F.col("compliance_result.state_disclosure_days").alias("compliance_state_disclosure_days"),
        F.array_join("compliance_result.findings", "|").alias("compliance_findings"),
        "action_rationale", "human_review_required",
    )


@register("audit_row", OR.audit_sql("SELECT * FROM audit"))
def q_audit_row(spark, sf):
    return _investigation(spark, sf).audit


_QUAR_Q = OR.queue_sql()


@register(
    "investigation_quarantine",
    OR.claims_with_replies(
        f"SELECT claim_id, quarantine_reason FROM ({OR.decision_sql(OR.parsed_all_sql(f'({_QUAR_Q}) q'))}) d "
        "WHERE quarantine_reason IS NOT NULL"
    ),
)
def q_investigation_quarantine(spark, sf):
    return _investigation(spark, sf).quarantine.select("claim_id", "quarantine_reason")


def _top_sql() -> str:
    parts = []
    for a in K.AGENTS:
        n = f"(CASE WHEN {a}_findings = '' THEN 0 ELSE len(string_split({a}_findings, '|')) END)"
        base = f"SELECT claim_id, '{OR.DISPLAY[a]}' AS agent_name, {a}_status AS status"
        parts.append(f"{base}, 1 AS finding_rank, string_split({a}_findings, '|')[1] AS finding FROM d WHERE {n} >= 1")
        parts.append(f"{base}, 2 AS finding_rank, string_split({a}_findings, '|')[2] AS finding FROM d WHERE {n} >= 2")
        parts.append(f"{base}, NULL AS finding_rank, NULL AS finding FROM d WHERE {n} = 0")
    decided = OR.decision_sql(OR.parsed_all_sql(f"({_QUAR_Q}) q"))
    return OR.claims_with_replies(
        f", d AS (SELECT * FROM ({decided}) x WHERE quarantine_reason IS NULL)\n" + " UNION ALL ".join(parts)
    )


@register("report_top_findings", _top_sql())
def q_report_top_findings(spark, sf):
    return RP.report_top_findings(_investigation(spark, sf).report)


# ---------------------------------------------------------------------------
# 2.6 measures and visuals over the audit log
# ---------------------------------------------------------------------------


@register("m_sar_count", OR.audit_sql("SELECT count(*) FILTER (WHERE sar_required = true) AS sar_count FROM audit"))
def q_m_sar_count(spark, sf):
    return M.m_sar_count(_investigation(spark, sf).audit)


@register(
    "m_hold_count",
    OR.audit_sql("SELECT count(*) FILTER (WHERE recommended_action = 'PLACE_PAYOUT_HOLD') AS hold_count FROM audit"),
)
def q_m_hold_count(spark, sf):
    return M.m_hold_count(_investigation(spark, sf).audit)


@register(
    "v_audit_detail",
    OR.audit_sql(
        "SELECT a.claim_id, a.recommended_action, a.composite_fraud_probability, a.sar_required, a.identity_status, "
        "a.property_status, a.pattern_status, a.compliance_status, a.investigated_at, g.claim_amount AS "
        "gold_claim_amount, g.fraud_risk_score, g.risk_tier, g.assigned_investigator FROM audit a JOIN gold g "
        "ON a.claim_id = g.claim_id"
    ),
)
def q_v_audit_detail(spark, sf):
    inv = _investigation(spark, sf)
    return M.v_audit_detail(inv.audit, L.gold(spark, sf))


@register(
    "v_agent_status",
    OR.audit_sql("SELECT claim_id, identity_status, property_status, pattern_status, compliance_status FROM audit"),
)
def q_v_agent_status(spark, sf):
    return M.v_agent_status(_investigation(spark, sf).audit)


@register(
    "v_action_counts",
    OR.audit_sql("SELECT recommended_action, count(*) AS claim_count FROM audit GROUP BY 1"),
)
def q_v_action_counts(spark, sf):
    return M.v_action_counts(_investigation(spark, sf).audit)


# ---------------------------------------------------------------------------
# 2.1 weighted categories, landing reader, sinks, layout; refresh; streaming
# ---------------------------------------------------------------------------


def _scratch(spark, name):
    return scratch_path(spark, f"q-{name}-{uuid.uuid4().hex[:10]}")


def _weighted_sql() -> str:
    acc, parts = 0.0, []
    total = float(sum(K.FRAUD_LABEL_WEIGHTS))
    for v, w in zip(K.FRAUD_LABELS[:-1], K.FRAUD_LABEL_WEIGHTS[:-1], strict=True):
        acc += w / total
        parts.append(f"when u < {acc!r} then '{v}'")
    return f"case {' '.join(parts)} else '{K.FRAUD_LABELS[-1]}' end"


@register(
    "src_weighted_choice",
    f"SELECT fraud_label, count(*) AS claim_count FROM (SELECT {_weighted_sql()} AS fraud_label FROM "
    "(SELECT (o_orderkey % 1000) / 1000.0 AS u FROM orders) t) x GROUP BY 1",
)
def q_src_weighted_choice(spark, sf):
    u = (F.col("o_orderkey") % 1000) / F.lit(1000.0)
    labels = read_table(spark, sf, "orders").select(
        weighted_choice(K.FRAUD_LABELS, K.FRAUD_LABEL_WEIGHTS, u).alias("fraud_label"))
    return labels.groupBy("fraud_label").agg(F.count(F.lit(1)).alias("claim_count"))


@register("src_landing_files", "SELECT * FROM orders")
def q_src_landing_files(spark, sf):
    schema = read_table(spark, sf, "orders").schema
    return LD.read_landing(spark, f"{sf}/orders.parquet", schema, fmt="parquet")


@register("src_landing_csv", "SELECT * FROM orders")
def q_src_landing_csv(spark, sf):
    # landing files whose header has another order than the schema: columns are bound by name
    base = _scratch(spark, "landing-csv")
    orders = read_table(spark, sf, "orders")
    orders.select(*reversed(orders.columns)).write.option("header", "true").csv(base)
    return LD.read_landing(spark, base, orders.schema, fmt="csv", keep_corrupt=False)


def _bad_line(k):
    """A line of the wrong number and types of values, one for every seventh order."""
    return F.concat(F.lit("CLM-bad-"), k.cast("string"), F.lit(",notabool,xx"))


@register(
    "src_landing_rejects",
    O.claims_sql(
        "SELECT 'good' AS outcome, * EXCLUDE (k), NULL AS record FROM claims UNION ALL SELECT 'malformed', "
        + ", ".join(["NULL"] * len(LD.BRONZE_CLAIMS_SCHEMA))
        + ", 'CLM-bad-' || k || ',notabool,xx' FROM claims WHERE k % 7 = 0"
    ),
)
def q_src_landing_rejects(spark, sf):
    # landing files with two orders of columns, and lines that are no claims: each line is a claim or a reject
    base = _scratch(spark, "landing-rejects")
    claims = FX.bronze_claims(spark, sf)
    half = F.pmod(F.xxhash64("claim_id"), F.lit(2)) == 0
    for name, rows in (("a", claims.filter(half)), ("b", claims.filter(~half).select(*reversed(claims.columns)))):
        rows.write.option("header", "true").csv(f"{base}/{name}")
    orders = read_table(spark, sf, "orders").filter("o_orderkey % 7 = 0")
    header = spark.range(1).select(F.lit(",".join(claims.columns)).alias("value"))
    bad = orders.select(_bad_line(F.col("o_orderkey")).alias("value"))
    header.unionByName(bad).coalesce(1).write.text(f"{base}/c")  # one file: its header stands among its lines
    landed = LD.split_landing(spark, f"{base}/*", LD.BRONZE_CLAIMS_SCHEMA, fmt="csv")
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in LD.BRONZE_CLAIMS_SCHEMA]
    rejects = landed.rejects.select(F.col("reason").alias("outcome"), *nulls, "record")
    return landed.good.select(F.lit("good").alias("outcome"), "*", F.lit(None).cast("string").alias("record")).unionByName(rejects)


@register("scan_table_named", "SELECT * FROM customer")
def q_scan_table_named(spark, sf):
    # a catalog table, bucketed by its key, written and read by name
    name, path = f"customer_{uuid.uuid4().hex[:10]}", _scratch(spark, "named")
    SK.sink_overwrite(read_table(spark, sf, "customer"), path, name, bucket_by=(4, "c_custkey"))
    return scan_table(spark, name)


@register(
    "row_security_session",
    O.gold_sql("SELECT claim_id, assigned_investigator, risk_tier FROM gold WHERE assigned_investigator < 'L'"),
)
def q_row_security_session(spark, sf):
    # gold as a catalog table, read through the view of the session's user, who has the
    # investigators before L; the others are other users'
    run = uuid.uuid4().hex[:10]
    gold, assigned, view = f"gold_{run}", f"investigator_users_{run}", f"my_claims_{run}"
    SK.sink_overwrite(L.gold(spark, sf), _scratch(spark, "secured"), gold)
    investigators = spark.table(gold).select(F.col("assigned_investigator").alias("investigator")).distinct()
    user = F.when(F.col("investigator") < "L", F.session_user()).otherwise(F.concat(F.lit("user of "), "investigator"))
    SK.sink_overwrite(investigators.withColumn("user_name", user), _scratch(spark, "assigned"), assigned)
    M.secured_view(spark, view, gold, assigned)
    return spark.table(view).select("claim_id", "assigned_investigator", "risk_tier")


@register("sink_overwrite", O.claims_sql("SELECT * EXCLUDE (k) FROM claims"))
def q_sink_overwrite(spark, sf):
    path = _scratch(spark, "overwrite")
    SK.sink_overwrite(FX.bronze_claims(spark, sf), path)
    SK.sink_overwrite(FX.bronze_claims(spark, sf), path)  # a second refresh replaces the first
    return spark.read.parquet(path)


@register(
    "sink_append_evolving",
    OR.audit_sql("SELECT *, NULL AS flagged_note FROM audit UNION ALL SELECT *, 'run 2' AS flagged_note FROM audit"),
)
def q_sink_append_evolving(spark, sf):
    # run 1 writes the 13 audit columns; run 2 adds a column; both readable together
    path = _scratch(spark, "append")
    inv = _investigation(spark, sf)
    SK.sink_append_evolving(inv.audit, path)
    SK.sink_append_evolving(inv.audit.withColumn("flagged_note", F.lit("run 2")), path)
    return SK.read_evolving(spark, path)


@register(
    "sink_append_rerun",
    OR.audit_sql("SELECT run, count(*) AS audit_rows, count(note) AS noted FROM (SELECT 'r1' AS run, NULL AS note FROM audit "
                 "UNION ALL SELECT 'r2', 'again' FROM audit) GROUP BY run"),
)
def q_sink_append_rerun(spark, sf):
    # run r1 twice (a retry), and run r2, which is repeated with a new column: each run's rows are there once
    path = _scratch(spark, "append-rerun")
    audit = _investigation(spark, sf).audit
    for run_id, rows in (("r1", audit), ("r2", audit), ("r1", audit), ("r2", audit.withColumn("note", F.lit("again")))):
        SK.sink_append_evolving(rows, path, run_id=run_id)
    return SK.read_evolving(spark, path).groupBy("run").agg(F.count(F.lit(1)).alias("audit_rows"), F.count("note").alias("noted"))


@register(
    "sink_append_table",
    OR.audit_sql("SELECT claim_id, recommended_action, run, note FROM (SELECT *, 'r1' AS run, NULL AS note FROM audit "
                 "UNION ALL SELECT *, 'r2', 'again' FROM audit)"),
)
def q_sink_append_table(spark, sf):
    # the same in a catalog table, bucketed by claim_id and partitioned by run
    name, path = f"audit_{uuid.uuid4().hex[:10]}", _scratch(spark, "append-table")
    audit = _investigation(spark, sf).audit
    for run_id, rows in (("r1", audit), ("r1", audit), ("r2", audit.withColumn("note", F.lit("again")))):
        SK.sink_append_table(rows, name, run_id, bucket_by=(4, "claim_id"), path=path)
    return scan_table(spark, name).select("claim_id", "recommended_action", "run", "note")


@register(
    "sink_report_json",
    OR.audit_sql("SELECT claim_id, recommended_action, composite_fraud_probability, identity_status, "
                 "compliance_status, sar_required FROM audit"),
)
def q_sink_report_json(spark, sf):
    # the JSON documents read back: one per report, nested fields intact
    path = _scratch(spark, "reports")
    SK.sink_report_json(_investigation(spark, sf).report, path)
    back = spark.read.json(path)
    return back.select(
        "claim_id", "recommended_action", "composite_fraud_probability",
        F.col("identity_result.status").alias("identity_status"),
        F.col("compliance_result.status").alias("compliance_status"),
        F.col("compliance_result.sar_required").alias("sar_required"),
    )


@register("rows_after_write", O.gold_sql("SELECT count(*) AS row_count FROM gold"))
def q_rows_after_write(spark, sf):
    path = _scratch(spark, "gold")
    SK.sink_overwrite(L.gold(spark, sf), path)
    return SK.rows_after_write(spark, path)


@register("layout_cluster", O.gold_sql("SELECT * FROM gold"))
def q_layout_cluster(spark, sf):
    # clustering only reorders rows: the row set must stay the gold table
    return LY.layout_cluster(L.gold(spark, sf))


@register("batch_refresh", _dq_report_sql())
def q_batch_refresh(spark, sf):
    res = RF.refresh(
        spark, FX.bronze_claims(spark, sf), FX.claimants(spark, sf), FX.properties(spark, sf),
        base=_scratch(spark, "refresh"), as_of=K.FIXTURE_AS_OF, scored_at=K.FIXTURE_SCORED_AT,
    )
    return RF.refresh_report(spark, res)


@register("stream_score", O.gold_sql("SELECT claim_id, fraud_risk_score, risk_tier, primary_alert FROM gold"))
def q_stream_score(spark, sf):
    # silver rows land as files; the stream scores them (stateless) into a sink
    base = _scratch(spark, "stream-score")
    SK.sink_overwrite(L.silver(spark, sf), f"{base}/silver")
    schema = spark.read.parquet(f"{base}/silver").schema
    stream = spark.readStream.schema(schema).parquet(f"{base}/silver")
    gold = ST.score_stream(stream, scored_at=K.FIXTURE_SCORED_AT)
    q = (gold.writeStream.format("parquet").option("path", f"{base}/gold")
         .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{base}/gold").select("claim_id", "fraud_risk_score", "risk_tier", "primary_alert")


@register("stream_velocity", O.silver_sql("SELECT claim_id, claim_velocity_24mo FROM silver"))
def q_stream_velocity(spark, sf):
    # bronze claims, joined once, arrive in filing order: one filing year at a time, in as
    # many files as its rows fill; the resumed stream takes each arrival as one micro-batch,
    # and foreachBatch keeps the daily-count state between them
    base = _scratch(spark, "stream-velocity")
    FX.bronze_claims(spark, sf).write.parquet(f"{base}/bronze")
    bronze = spark.read.parquet(f"{base}/bronze")
    years = [r["y"] for r in bronze.select(F.year("filed_date").alias("y")).distinct().orderBy("y").collect()]
    for y in years:  # a handful of years
        bronze.filter(F.year("filed_date") == y).write.mode("append").parquet(f"{base}/landing")
        stream = LD.read_landing_stream(spark, f"{base}/landing", LD.BRONZE_CLAIMS_SCHEMA)
        q, _ = ST.run_velocity_stream(stream, base, as_of=K.FIXTURE_AS_OF, scored_at=K.FIXTURE_SCORED_AT)
        q.awaitTermination()
    return spark.read.parquet(f"{base}/gold").select("claim_id", "claim_velocity_24mo")


@register(
    "alert_throttle",
    "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR "
    "AS window_end, min(ts) AS alert_ts, arg_min(value, ts) AS alert_value FROM events WHERE value > 50 GROUP BY 1",
)
def q_alert_throttle(spark, sf):
    ev = read_table(spark, sf, "events").select("ts", "value")
    return M.alert_throttle(ev, threshold=50)


@register(
    "alert_throttle_stream",
    "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR "
    "AS window_end, min(ts) AS alert_ts, arg_min(value, ts) AS alert_value FROM events WHERE value > 50 GROUP BY 1",
)
def q_alert_throttle_stream(spark, sf):
    # evaluations arrive in time order (eight consecutive time slices), then one
    # without a breach three hours later, as a running monitor sends: it moves the
    # watermark past the last hour, so every hour is emitted, exactly once
    base = _scratch(spark, "alert-stream")
    ev = read_table(spark, sf, "events").select("ts", "value")
    b = ev.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    step = (b["hi"] - b["lo"]) / 8
    for i in range(8):
        lo = b["lo"] + step * i
        part = ev.filter(F.col("ts") >= F.lit(lo))
        part = part.filter(F.col("ts") < F.lit(lo + step)) if i < 7 else part
        part.coalesce(1).write.mode("append").parquet(f"{base}/in")
    late = ev.agg((F.max("ts") + F.expr("INTERVAL 3 HOURS")).alias("ts"), F.lit(0.0).alias("value"))
    late.write.mode("append").parquet(f"{base}/in")
    # event time must be TIMESTAMP for a watermark (the files hold TIMESTAMP_NTZ; UTC session)
    stream = spark.readStream.schema("ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(
        f"{base}/in")
    out = ST.alert_throttle_stream(stream, threshold=50)
    q = (out.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")
