"""Claims-domain views over the driver's TPC-H-style test tables.

customer -> claimants, part -> properties, orders (+ lineitem) -> bronze claims,
plus per-claim agent replies and the conversation threads used by
``reply_select``.  Everything is a lazy DataFrame over the parquet scans, so the
work grows with the tables.

Scale notes: the only aggregate is ``min(l_partkey)`` per order (map-side partial
aggregation, one shuffle of the partial rows); the dimension joins are on the
integer keys (cheaper to hash and compare than the formatted string ids).
Spark/AQE chooses broadcast vs. sort-merge from the measured size of each side
(``spark.sql.autoBroadcastJoinThreshold``), so no unbounded side is ever
broadcast by hint, and a hot customer key is split by AQE's skew-join handling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.constants import AGENT_FLAG_STATUS, AGENTS, ORCHESTRATOR_AGENT, STATES, VELOCITY_WINDOW_DAYS
from claimscope.sources.tables import read_table


def _pick(values: tuple[str, ...], index: Column) -> Column:
    """values[index] for a 0-based integer column (NULL outside the range)."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _str(c: Column) -> Column:
    return c.cast("string")


# ---------------------------------------------------------------------------
# claimants / properties / claims
# ---------------------------------------------------------------------------

def claimants_keyed(customer: DataFrame) -> DataFrame:
    """Claimants with the source key ``c_custkey`` kept for key joins."""
    k = F.col("c_custkey")
    return customer.select(
        k,
        F.concat(F.lit("CLM-ID-"), _str(F.lit(10000) + k)).alias("claimant_id"),
        _pick(("Ann", "Ben", "Cora", "Dev"), k % 4).alias("first_name"),
        F.col("c_name").alias("last_name"),
        _pick(STATES, F.col("c_nationkey") % 10).alias("state"),
        _str(F.lit(1000) + (k * 7919) % 9000).alias("ssn_last4"),
        (F.col("c_acctbal") >= 1000).alias("id_verified"),
        (F.lit(30) + (k * 97) % 3621).cast("bigint").alias("account_age_days"),
    )


def claimants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze claimants (7 columns)."""
    return claimants_keyed(read_table(spark, sf_dir, "customer")).drop("c_custkey")


def properties_keyed(part: DataFrame) -> DataFrame:
    """Properties with the source key ``p_partkey`` kept for key joins."""
    k = F.col("p_partkey")
    pct = F.when(k % 5 == 0, F.lit(22) + (k * 7) % 43).otherwise((k * 7) % 17 - 5).cast("double")
    closing = F.col("p_retailprice") * 1000
    return (
        part.select(
            k,
            F.concat(F.lit("PROP-"), _str(F.lit(20000) + k)).alias("property_id"),
            _pick(STATES, k % 10).alias("state"),
            F.col("p_type").alias("county"),
            closing.alias("value_at_closing"),
            pct.alias("value_pct_change"),
            (F.lit(30) + (k * 31) % 701).cast("bigint").alias("days_since_closing"),
            (F.col("p_size") <= 4).alias("has_lien"),
        )
        .withColumn(
            "current_value",
            F.round(F.col("value_at_closing") * (1 + F.col("value_pct_change") / 100), 0),
        )
        .select(
            "p_partkey", "property_id", "state", "county", "value_at_closing",
            "current_value", "value_pct_change", "days_since_closing", "has_lien",
        )
    )


def properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze properties (8 columns)."""
    return properties_keyed(read_table(spark, sf_dir, "part")).drop("p_partkey")


def order_property_keys(lineitem: DataFrame) -> DataFrame:
    """One property key per order: the smallest part key of its line items."""
    return lineitem.groupBy("l_orderkey").agg(F.min("l_partkey").alias("pk"))


CLAIM_COLUMNS = (
    "claim_id", "claimant_id", "property_id", "claim_type", "fraud_label", "is_confirmed_fraud",
    "claim_amount", "claim_status", "filed_date", "resolved_date", "assigned_investigator",
    "state", "id_verified", "value_pct_change", "has_lien", "account_age_days",
)


def claim_columns(orders: DataFrame) -> DataFrame:
    """The claim-only columns of each order (no dimension attributes yet).

    Keeps ``o_orderkey``/``o_custkey``/``pk`` for the key joins.
    """
    k = F.col("o_orderkey")
    pct100 = k % 100
    label = (
        F.when(pct100 < 8, "WIRE_FRAUD").when(pct100 < 15, "ID_MISMATCH").when(pct100 < 21, "VELOCITY")
        .when(pct100 < 26, "TITLE_DEFECT").when(pct100 < 30, "FORGERY").when(pct100 < 33, "STRAW_BUYER")
        .otherwise("NONE")
    )
    status = (
        F.when(F.col("o_orderstatus") == "O", "OPEN").when(F.col("o_orderstatus") == "P", "UNDER_REVIEW")
        .when(k % 3 == 0, "PAID").when(k % 3 == 1, "DENIED").otherwise("ESCALATED")
    )
    filed = F.to_date("o_orderdate")
    prio = F.substring("o_orderpriority", 1, 1)
    investigator = (
        F.when(prio == "1", "J.Rivera").when(prio == "2", "K.Thomas").when(prio == "3", "M.Chen")
        .when(prio == "4", "S.Patel").otherwise("L.Johnson")
    )
    return orders.select(
        "o_orderkey", "o_custkey", "pk",
        F.concat(F.lit("CLM-"), _str(F.year("o_orderdate")), F.lit("-"), _str(F.lit(7000) + k)).alias("claim_id"),
        F.concat(F.lit("CLM-ID-"), _str(F.lit(10000) + F.col("o_custkey"))).alias("claimant_id"),
        F.when(F.col("pk").isNotNull(), F.concat(F.lit("PROP-"), _str(F.lit(20000) + F.col("pk")))).alias("property_id"),
        _pick(("LIEN", "FORGERY", "ENCUMBRANCE", "WIRE_FRAUD", "TITLE_DEFECT", "ID_FRAUD"), k % 6).alias("claim_type"),
        label.alias("fraud_label"),
        (pct100 < 33).alias("is_confirmed_fraud"),
        F.col("o_totalprice").alias("claim_amount"),
        status.alias("claim_status"),
        filed.alias("filed_date"),
        F.when(F.col("o_orderstatus") == "F", F.date_add(filed, (F.lit(5) + k % 176).cast("int"))).alias("resolved_date"),
        investigator.alias("assigned_investigator"),
    )


def claim_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim-only columns of every order plus the join keys (o_custkey, pk)."""
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"
    )
    pk = order_property_keys(read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"))
    return claim_columns(orders.join(pk, orders.o_orderkey == pk.l_orderkey, "left"))


def attach_dimensions(spark: SparkSession, sf_dir: str, base: DataFrame) -> DataFrame:
    """Claimant (state, id_verified, account_age_days) and property
    (value_pct_change, has_lien) attributes joined on the integer keys.

    Both dimensions have one row per key, so the left joins never change the
    number of claims -- which is why per-claim features such as velocity may
    be computed before or after this step with the same result.
    """
    cl = claimants_keyed(read_table(spark, sf_dir, "customer")).select(
        "c_custkey", "state", "id_verified", "account_age_days"
    )
    pr = properties_keyed(read_table(spark, sf_dir, "part")).select("p_partkey", "value_pct_change", "has_lien")
    return base.join(pr, base.pk == pr.p_partkey, "left").join(cl, base.o_custkey == cl.c_custkey, "left")


def claim_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(claim_id, claimant_id, filed_date) of every claim, from the orders alone."""
    orders = read_table(spark, sf_dir, "orders").withColumn("pk", F.lit(None).cast("bigint"))
    return claim_columns(orders).select("claim_id", "claimant_id", "filed_date")


def bronze_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze claims (16 columns): orders + their property key, denormalised
    with claimant and property attributes (left joins on the integer keys)."""
    return attach_dimensions(spark, sf_dir, claim_base(spark, sf_dir)).select(*CLAIM_COLUMNS)


# ---------------------------------------------------------------------------
# agent replies and threads
# ---------------------------------------------------------------------------

def _q(text: Column | str) -> Column:
    """A JSON string literal around a plain (quote-free) text column."""
    t = F.lit(text) if isinstance(text, str) else text
    return F.concat(F.lit('"'), t, F.lit('"'))


def _whole(k: Column, n: int) -> Column:
    """``k % n`` as a number, now and then as a text of it with decimal zeros (accepted)."""
    return F.when(k % 11 == 5, F.concat(F.lit('"'), _str(k % n), F.lit('.00"'))).otherwise(_str(k % n))


def _flag(k: Column, value: Column) -> Column:
    """A boolean, now and then a text with blanks around the word (refused)."""
    return F.when(k % 13 == 4, F.lit('" true "')).when(value, F.lit("true")).otherwise(F.lit("false"))


def _valid_reply(agent: str, k: Column, status: Column) -> Column:
    """Text of a well-formed reply of ``agent`` for order key ``k``."""
    delta = F.concat(F.lit("0."), F.lpad(_str(F.lit(5) + (k % 7) * 5), 2, "0"))
    findings = F.concat(
        F.lit('["finding one for '), _str(k), F.lit('", "finding two for '), _str(k),
        F.lit('", "finding three for '), _str(k), F.lit('"]'),
    )
    common = [
        F.lit('{"status": '), _q(status), F.lit(', "findings": '), findings,
        F.lit(', "risk_delta": '), delta,
    ]
    if agent == "identity":
        extra = [
            F.lit(', "ssn_discrepancies": '), _whole(k, 6),
            F.lit(', "address_changes_18mo": '), _str(k % 4),
            F.lit(', "watchlist_match": '), _flag(k, k % 2 == 0),
            F.lit(', "id_doc_issues": ["doc issue '), _str(k % 3), F.lit('"]'),
            F.lit(', "recommendation": "REQUEST_IN_PERSON_VERIFICATION"}'),
        ]
    elif agent == "property":
        extra = [
            F.lit(', "value_change_pct": '), _str(k % 50), F.lit(".5"),
            F.lit(', "title_transfers_24mo": '), _whole(k, 5),
            F.lit(', "comparable_sale_gap_pct": '), _str(k % 30),
            F.lit(', "lien_count": '), _str(k % 3),
            F.lit(', "recommendation": "ORDER_INDEPENDENT_APPRAISAL"}'),
        ]
    elif agent == "claims_pattern":
        extra = [
            F.lit(', "pattern_cohort": '),
            F.when(k % 2 == 0, F.lit('"WIRE_FRAUD_RING"')).otherwise(F.lit("null")),
            F.lit(', "cohort_similarity_pct": '), _str(k % 100),
            F.lit(', "shared_identifiers": ["phone", "bank account"]'),
            F.lit(', "prior_denied_claims": '), _whole(k, 4),
            F.lit(', "recommendation": "ESCALATE_TO_SIU"}'),
        ]
    else:  # compliance: disclosure days given, explicit null, or missing
        days = (
            F.when(k % 3 == 0, F.concat(F.lit(', "state_disclosure_days": '), _str(F.lit(5) + k % 20)))
            .when(k % 3 == 1, F.lit(', "state_disclosure_days": null'))
            .otherwise(F.lit(""))
        )
        extra = [
            F.lit(', "sar_required": '), _flag(k, k % 4 != 0),
            F.lit(', "alta_practices_triggered": ["7"]'),
            days,
            F.lit(', "regulatory_notes": ["notify within window"]'),
            F.lit(', "recommendation": "INITIATE_SAR_FILING"}'),
        ]
    return F.concat(*common, *extra)


#: String deltas: a decimal, texts that only Java's or C's grammar takes, underscores, blanks, a bad underscore.
DELTA_TEXTS = ("0.1", "0.1d", "0.1f", "0x1p-1", "1_0e-2", " 0.1 ", "1__0e-2", "-.25")


def agent_reply_text(agent: str, k: Column) -> Column:
    """Reply text of ``agent`` for order key ``k``; its class is
    ``(k + 3 * agent_index) % 10``:

    0 malformed text, 1 ``{}``, 2 unknown status, 3 risk_delta 5, 4 explicit
    null delta, 5 a string delta ("0.1" and texts that only some number
    grammars take), 6 a JSON array, 7-8 valid and flagged, 9 valid and CLEAR
    (7-9 carry three findings and a delta 0.05..0.35).
    """
    flag = AGENT_FLAG_STATUS[agent]
    cls = (k + 3 * AGENTS.index(agent)) % 10
    return (
        F.when(cls == 0, F.concat(F.lit("not json {"), _str(k)))
        .when(cls == 1, F.lit("{}"))
        .when(cls == 2, F.lit('{"status": "MAYBE", "risk_delta": 0.1}'))
        .when(cls == 3, F.lit(f'{{"status": "{flag}", "risk_delta": 5}}'))
        .when(cls == 4, F.lit(f'{{"status": "{flag}", "risk_delta": null}}'))
        .when(cls == 5, F.concat(F.lit(f'{{"status": "{flag}", "risk_delta": "'),
                                 _pick(DELTA_TEXTS, F.floor(k / 10) % len(DELTA_TEXTS)), F.lit('"}')))
        .when(cls == 6, F.lit("[1, 2, 3]"))
        .when(cls <= 8, _valid_reply(agent, k, F.lit(flag)))
        .otherwise(_valid_reply(agent, k, F.lit("CLEAR")))
    )


def synthesis_reply_text(k: Column) -> Column:
    """Orchestrator reply for order key ``k``, class ``k % 8``: 0 malformed
    (fallback decision), 1 ``{}`` (defaults), 2 unknown action, 3 probability
    1.5, 4 probability as a numeric string, 5-7 valid."""
    cls = k % 8
    actions = ("PLACE_PAYOUT_HOLD", "ESCALATE_TO_SIU", "REQUEST_DOCUMENTATION", "STANDARD_REVIEW", "CLEAR_FOR_PAYMENT")
    prob = F.concat(F.lit("0."), _str(F.lit(50) + k % 45))
    return (
        F.when(cls == 0, F.lit("synthesis unavailable"))
        .when(cls == 1, F.lit("{}"))
        .when(cls == 2, F.lit('{"composite_fraud_probability": 0.9, "recommended_action": "FREEZE_ACCOUNT", "action_rationale": "x"}'))
        .when(cls == 3, F.lit('{"composite_fraud_probability": 1.5, "recommended_action": "ESCALATE_TO_SIU", "action_rationale": "x"}'))
        .when(cls == 4, F.lit('{"composite_fraud_probability": "0.8", "recommended_action": "REQUEST_DOCUMENTATION"}'))
        .otherwise(F.concat(
            F.lit('{"composite_fraud_probability": '), prob,
            F.lit(', "recommended_action": '), _q(_pick(actions, k % 5)),
            F.lit(', "action_rationale": "Rationale for claim '), _str(k), F.lit('."}'),
        ))
    )


def agent_replies(spark: SparkSession, sf_dir: str, include_synthesis: bool = True) -> DataFrame:
    """Replies table ``(claim_id, agent, raw_response, turn)``: one row per claim
    and agent (four specialists, plus the orchestrator when
    ``include_synthesis``), but of every 17 one is absent, one has a NULL text
    and one is followed by a second reply ``{}``."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    k = F.col("o_orderkey")
    claim_id = F.concat(F.lit("CLM-"), _str(F.year("o_orderdate")), F.lit("-"), _str(F.lit(7000) + k))
    texts = [(a, agent_reply_text(a, k)) for a in AGENTS]
    if include_synthesis:
        texts.append((ORCHESTRATOR_AGENT, synthesis_reply_text(k)))
    pairs = []
    for i, (agent, text) in enumerate(texts):
        slot = (k + 5 * i) % 17

        def reply(turn: int, shown: Column, name: str = agent) -> Column:
            return F.struct(F.lit(name).alias("agent"), shown.alias("raw_response"), F.lit(turn).alias("turn"))

        pairs.append(F.when(slot != 0, reply(1, F.when(slot != 1, text))))
        pairs.append(F.when(slot == 2, reply(2, F.lit("{}"))))
    return (
        orders.select(claim_id.alias("claim_id"), F.explode(F.array_compact(F.array(*pairs))).alias("r"))
        .select("claim_id", "r.agent", "r.raw_response", "r.turn")
    )


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agent threads ``(thread_id, turn, role, text)`` from ``conversations``."""
    return read_table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("thread_id"), "turn", "role", "text"
    )
