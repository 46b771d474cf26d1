"""Independent DuckDB SQL for every checked operator.

The text below is the correctness oracle: it rebuilds the claims views from
the raw test tables (customer, part, orders, lineitem, conversations) in plain
ANSI/DuckDB SQL and expresses each operator as a query over them.  It shares
no code with the Spark implementation.
"""

from __future__ import annotations

AS_OF = "DATE '2001-08-01'"
SCORED_AT = "TIMESTAMP '2001-08-01 00:00:00'"

STATE_CASE = (
    "case {e} when 0 then 'TX' when 1 then 'FL' when 2 then 'CA' when 3 then 'NY' when 4 then 'IL' "
    "when 5 then 'AZ' when 6 then 'GA' when 7 then 'NC' when 8 then 'OH' else 'PA' end"
)

CLAIMANTS = f"""
claimants AS (
  SELECT c_custkey,
         concat('CLM-ID-', cast(10000 + c_custkey AS varchar)) AS claimant_id,
         case c_custkey % 4 when 0 then 'Ann' when 1 then 'Ben' when 2 then 'Cora' else 'Dev' end AS first_name,
         c_name AS last_name,
         {STATE_CASE.format(e='c_nationkey % 10')} AS state,
         cast(1000 + (c_custkey * 7919) % 9000 AS varchar) AS ssn_last4,
         c_acctbal >= 1000 AS id_verified,
         cast(30 + (c_custkey * 97) % 3621 AS bigint) AS account_age_days
  FROM customer)"""

PROPERTIES = f"""
properties0 AS (
  SELECT p_partkey,
         concat('PROP-', cast(20000 + p_partkey AS varchar)) AS property_id,
         {STATE_CASE.format(e='p_partkey % 10')} AS state,
         p_type AS county,
         p_retailprice * 1000 AS value_at_closing,
         cast(case when p_partkey % 5 = 0 then 22 + (p_partkey * 7) % 43
                   else (p_partkey * 7) % 17 - 5 end AS double) AS value_pct_change,
         cast(30 + (p_partkey * 31) % 701 AS bigint) AS days_since_closing,
         p_size <= 4 AS has_lien
  FROM part),
properties AS (
  SELECT p_partkey, property_id, state, county, value_at_closing,
         round(value_at_closing * (1 + value_pct_change / 100), 0) AS current_value,
         value_pct_change, days_since_closing, has_lien
  FROM properties0)"""

CLAIMS = """
pk AS (SELECT l_orderkey, min(l_partkey) AS pk FROM lineitem GROUP BY l_orderkey),
claims AS (
  SELECT concat('CLM-', cast(extract(year FROM o.o_orderdate) AS varchar), '-', cast(7000 + o.o_orderkey AS varchar)) AS claim_id,
         concat('CLM-ID-', cast(10000 + o.o_custkey AS varchar)) AS claimant_id,
         case when pk.pk IS NULL then NULL else concat('PROP-', cast(20000 + pk.pk AS varchar)) end AS property_id,
         case o.o_orderkey % 6 when 0 then 'LIEN' when 1 then 'FORGERY' when 2 then 'ENCUMBRANCE'
              when 3 then 'WIRE_FRAUD' when 4 then 'TITLE_DEFECT' else 'ID_FRAUD' end AS claim_type,
         case when o.o_orderkey % 100 < 8 then 'WIRE_FRAUD' when o.o_orderkey % 100 < 15 then 'ID_MISMATCH'
              when o.o_orderkey % 100 < 21 then 'VELOCITY' when o.o_orderkey % 100 < 26 then 'TITLE_DEFECT'
              when o.o_orderkey % 100 < 30 then 'FORGERY' when o.o_orderkey % 100 < 33 then 'STRAW_BUYER'
              else 'NONE' end AS fraud_label,
         o.o_orderkey % 100 < 33 AS is_confirmed_fraud,
         o.o_totalprice AS claim_amount,
         case when o.o_orderstatus = 'O' then 'OPEN' when o.o_orderstatus = 'P' then 'UNDER_REVIEW'
              when o.o_orderkey % 3 = 0 then 'PAID' when o.o_orderkey % 3 = 1 then 'DENIED' else 'ESCALATED' end AS claim_status,
         cast(o.o_orderdate AS date) AS filed_date,
         case when o.o_orderstatus = 'F' then cast(o.o_orderdate AS date) + cast(5 + o.o_orderkey % 176 AS integer) end AS resolved_date,
         case substr(o.o_orderpriority, 1, 1) when '1' then 'J.Rivera' when '2' then 'K.Thomas' when '3' then 'M.Chen'
              when '4' then 'S.Patel' else 'L.Johnson' end AS assigned_investigator,
         c.state, c.id_verified, p.value_pct_change, p.has_lien, c.account_age_days,
         o.o_orderkey AS k
  FROM orders o
  LEFT JOIN pk ON o.o_orderkey = pk.l_orderkey
  LEFT JOIN claimants c ON o.o_custkey = c.c_custkey
  LEFT JOIN properties p ON pk.pk = p.p_partkey)"""

VELOCITY_TRAILING = (
    "count(claim_id) OVER (PARTITION BY claimant_id ORDER BY filed_date "
    "RANGE BETWEEN INTERVAL 720 DAY PRECEDING AND CURRENT ROW)"
)
VELOCITY_AS_WRITTEN = "count(claim_id) OVER (PARTITION BY claimant_id)"


def silver_cte(velocity: str = VELOCITY_TRAILING) -> str:
    return f"""
silver AS (
  SELECT *, {velocity} AS claim_velocity_24mo,
         claim_amount > 100000 AS is_high_value,
         value_pct_change > 20.0 AS property_spike,
         cast(date_diff('day', filed_date, {AS_OF}) AS integer) AS days_since_filed,
         case when date_diff('day', filed_date, {AS_OF}) <= 30 then 'LAST_30D'
              when date_diff('day', filed_date, {AS_OF}) <= 90 then 'LAST_90D'
              when date_diff('day', filed_date, {AS_OF}) <= 365 then 'LAST_YEAR'
              else 'OLDER' end AS recency_bucket
  FROM claims)"""


def scored_cte(high: float = 0.75, medium: float = 0.45) -> str:
    return f"""
sig AS (
  SELECT *,
         cast(least(1.0, cast(claim_velocity_24mo - 1 AS double) / 4.0) AS double) AS sig_velocity,
         case when id_verified = false then 1.0 else 0.0 end AS sig_id_unverified,
         case when value_pct_change > 40.0 then 1.0 when value_pct_change > 20.0 then 0.65 else 0.0 end AS sig_property_spike,
         case when claim_amount > 250000 then 1.0 when claim_amount > 100000 then 0.55 else 0.0 end AS sig_high_value,
         case when account_age_days < 180 then 0.8 when account_age_days < 365 then 0.4 else 0.0 end AS sig_new_account,
         case when has_lien = true then 0.6 else 0.0 end AS sig_lien
  FROM silver),
sc AS (
  SELECT *, round(least(0.99, sig_velocity * 0.30 + sig_id_unverified * 0.28 + sig_property_spike * 0.20
                       + sig_high_value * 0.12 + sig_new_account * 0.06 + sig_lien * 0.04), 3) AS fraud_risk_score
  FROM sig),
tiered AS (
  SELECT *, case when fraud_risk_score >= {high} then 'HIGH' when fraud_risk_score >= {medium} then 'MEDIUM'
                 else 'LOW' end AS risk_tier
  FROM sc),
scored AS (
  SELECT *,
         case when sig_id_unverified >= 0.8 AND risk_tier = 'HIGH' then 'IDENTITY_VERIFICATION_REQUIRED'
              when sig_velocity >= 0.75 AND risk_tier = 'HIGH' then 'ABNORMAL_CLAIM_VELOCITY'
              when sig_property_spike >= 0.65 AND risk_tier IN ('HIGH', 'MEDIUM') then 'PROPERTY_VALUE_ANOMALY'
              when risk_tier = 'HIGH' then 'MULTI_SIGNAL_FRAUD_RISK'
              else 'NONE' end AS primary_alert,
         {SCORED_AT} AS scored_at
  FROM tiered),
gold AS (
  SELECT claim_id, claimant_id, property_id, state, claim_type, claim_amount, claim_status, filed_date,
         resolved_date, assigned_investigator, recency_bucket, days_since_filed, fraud_risk_score, risk_tier,
         primary_alert, sig_velocity, sig_id_unverified, sig_property_spike, sig_high_value, sig_new_account,
         claim_velocity_24mo, id_verified, value_pct_change, has_lien, account_age_days, is_confirmed_fraud,
         fraud_label, scored_at
  FROM scored)"""


def with_ctes(*parts: str) -> str:
    return "WITH " + ",".join(parts)


BASE = (CLAIMANTS, PROPERTIES, CLAIMS)


def gold_sql(body: str, high: float = 0.75, medium: float = 0.45, velocity: str = VELOCITY_TRAILING) -> str:
    """``body`` over the views claimants, properties, claims, silver, scored, gold."""
    return with_ctes(*BASE, silver_cte(velocity), scored_cte(high, medium)) + "\n" + body


def claims_sql(body: str) -> str:
    return with_ctes(*BASE) + "\n" + body


def silver_sql(body: str, velocity: str = VELOCITY_TRAILING) -> str:
    return with_ctes(*BASE, silver_cte(velocity)) + "\n" + body


# exact average of 3-decimal values rounded half-up to 3 decimals
def avg3(col: str) -> str:
    s = f"sum(cast(round({col} * 1000) AS bigint))"
    n = f"count({col})"
    return f"(sign({s}) * ((2 * abs({s}) + {n}) // (2 * {n})) / 1000.0)"


def avg3_raw(col: str) -> str:
    return f"(cast(sum(cast(round({col} * 1000) AS bigint)) AS double) / (count({col}) * 1000.0))"


def money_sum(col: str, digits: int = 2) -> str:
    return f"cast(round(sum(cast({col} AS decimal(18,2))), {digits}) AS double)"


def money_millions(col: str, digits: int = 2) -> str:
    return f"(cast(round(sum(cast({col} AS decimal(18,2))), {digits - 6}) AS double) / 1000000.0)"
