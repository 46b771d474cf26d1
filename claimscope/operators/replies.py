"""Agent replies: selection from threads, typed parsing, error rows, pivot.

A replies table is ``(claim_id, agent, raw_response)``, with an optional
``turn`` that orders several replies of one agent to one claim: the first one
counts, ``repeated_replies`` lists the others.  Parsing is a row-wise
projection (no UDF): the reply is parsed once into a VARIANT, every field is
extracted with its type rule, and a reply that is not valid JSON, not an
object, or has an unacceptable field becomes an ERROR result with a fixed
reason code.  A claim without a reply of an agent (no row, or a NULL text) is
an ERROR result too, with reason ``NO_REPLY``: a call that failed is never
read as "all clear".  (``{}`` stands for a thread without an assistant
message, see ``reply_select``.)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimscope import constants as K
from claimscope.functions import reply_json as J
from claimscope.operators.rules import disclosure_days

# ---------------------------------------------------------------------------
# selection
# ---------------------------------------------------------------------------


def reply_select(
    threads: DataFrame,
    key: str = "thread_id",
    order: str = "turn",
    role: str = "assistant",
    default: str = "{}",
) -> DataFrame:
    """First ``role`` message of each thread in listing order, else ``default``.

    ``min_by`` aggregates partially on the map side, so a very long thread is
    reduced before the shuffle and never held in one task.
    """
    text = F.when(F.col("role") == role, F.col("text"))
    # (position, text) orders ties on the position deterministically
    pos = F.when(F.col("role") == role, F.struct(F.col(order), F.col("text")))
    picked = threads.groupBy(key).agg(F.min_by(text, pos).alias("_t"))
    return picked.select(key, F.coalesce(F.col("_t"), F.lit(default)).alias("raw_response"))


def replies_from_threads(threads: DataFrame, thread_index: DataFrame, **select_kw) -> DataFrame:
    """The replies table ``(claim_id, agent, raw_response)`` from agent threads:
    the selected message of each thread (``reply_select``) joined to an index
    ``(thread_id, claim_id, agent)``; an indexed thread without an assistant
    message yields ``{}``, an unindexed thread is ignored."""
    key = select_kw.get("key", "thread_id")
    picked = reply_select(threads, **select_kw)
    index = thread_index.select(F.col(key), "claim_id", "agent")
    joined = index.join(picked, key, "left")
    return joined.select("claim_id", "agent", F.coalesce("raw_response", F.lit(select_kw.get("default", "{}")))
                         .alias("raw_response"))


# ---------------------------------------------------------------------------
# agent result specs
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    default: object  # python literal, or a callable returning a Column over the claim row
    error_default: object


def _lit(value, kind: str) -> Column:
    if kind == "str_list":
        return F.array().cast("array<string>")
    return F.lit(value).cast(J.SQL_TYPES[kind])


COMMON_HEAD = [Field("status", "status", "CLEAR", "ERROR")]
COMMON_TAIL = [
    Field("findings", "str_list", [], None),
    Field("risk_delta", "float", 0.0, 0.0),
    Field("recommendation", "str", K.DEFAULT_RECOMMENDATION, K.ERROR_RECOMMENDATION),
]

AGENT_FIELDS: dict[str, list[Field]] = {
    "identity": COMMON_HEAD + [
        Field("ssn_discrepancies", "int", 0, 0),
        Field("address_changes_18mo", "int", 0, 0),
        Field("watchlist_match", "bool", False, False),
        Field("id_doc_issues", "str_list", [], []),
    ] + COMMON_TAIL,
    "property": COMMON_HEAD + [
        Field("value_change_pct", "float", lambda: F.col("value_pct_change"), 0.0),
        Field("title_transfers_24mo", "int", 0, 0),
        Field("comparable_sale_gap_pct", "float", 0.0, 0.0),
        Field("lien_count", "int", lambda: F.when(F.col("has_lien"), 1).otherwise(0), 0),
    ] + COMMON_TAIL,
    "claims_pattern": COMMON_HEAD + [
        Field("pattern_cohort", "opt_str", None, None),
        Field("cohort_similarity_pct", "float", 0.0, 0.0),
        Field("shared_identifiers", "str_list", [], []),
        Field("prior_denied_claims", "int", 0, 0),
    ] + COMMON_TAIL,
    "compliance": COMMON_HEAD + [
        Field("sar_required", "bool", False, False),
        Field("alta_practices_triggered", "str_list", [], []),
        Field("state_disclosure_days", "opt_int", lambda: disclosure_days(F.col("state")), None),
        Field("regulatory_notes", "str_list", [], []),
    ] + COMMON_TAIL,
}


def _default(f: Field) -> Column:
    return f.default() if callable(f.default) else _lit(f.default, f.kind)


def _reason(v: Column, checks: list[tuple[str, Column]], raw: Column | None = None) -> Column:
    """First failing reason code, NULL when the reply is acceptable."""
    obj = J.is_object(v) if raw is None else J.is_object_text(raw, v)
    if raw is None:
        expr = F.when(v.isNull(), F.lit("MALFORMED_JSON"))
    else:
        expr = F.when(raw.isNull(), F.lit("NO_REPLY")).when(v.isNull(), F.lit("MALFORMED_JSON"))
    expr = expr.when(~obj, F.lit("NOT_AN_OBJECT"))
    for code, ok in checks:
        expr = expr.when(~ok, F.lit(code))
    return expr


def parse_agent_result(agent: str, raw: Column | None = None) -> Column:
    """The typed result struct of ``agent`` for a reply column (single
    expression; prefer ``with_agent_result`` on DataFrames, which parses the
    text once per row).

    Defaults that depend on the claim (property value change and lien count,
    compliance disclosure window) read the claim columns of the same row.
    """
    raw = F.col("raw_response") if raw is None else raw
    return _result_struct(agent, J.parse(raw), raw, lambda name: J.field(J.parse(raw), name), lambda name: None)


def _result_struct(agent: str, v: Column, raw: Column, field_of, type_of) -> Column:
    fields = AGENT_FIELDS[agent]
    values, checks = {}, []
    for f in fields:
        val, ok = J.extract_from(field_of(f.name), f.kind, _default(f), type_of(f.name))
        values[f.name] = val
        checks.append((f"INVALID_{f.name.upper()}", ok))
    delta = values["risk_delta"]
    checks.append(("RISK_DELTA_OUT_OF_RANGE", F.coalesce((delta >= -1.0) & (delta <= 1.0), F.lit(False))))
    reason = _reason(v, checks, raw)
    ok_all = reason.isNull()

    cols = [F.lit(K.AGENT_DISPLAY_NAMES[agent]).alias("agent_name")]
    for f in fields:
        if f.name == "status":
            err = F.lit("ERROR")
        elif f.name == "findings":
            err = F.array(F.concat(F.lit(K.ERROR_FINDING_PREFIX), reason))
        else:
            err = _lit(f.error_default, f.kind) if f.kind != "str_list" else F.array().cast("array<string>")
        cols.append(F.when(ok_all, values[f.name]).otherwise(err).alias(f.name))
    cols.append(F.when(ok_all, raw).alias("raw_response"))
    cols.append(reason.alias("error_reason"))
    return F.struct(*cols)


def with_agent_result(df: DataFrame, agent: str, raw: str, out: str) -> DataFrame:
    """Add ``out``: the typed result of ``agent`` for the reply text in ``raw``."""
    return with_agent_results(df, [(agent, raw, out)])


_STAGE_CACHE: dict[tuple, dict] = {}


def _names(agent: str, out: str) -> dict:
    p = f"_{out}_"
    fields = AGENT_FIELDS[agent]
    return {
        "v": f"{p}v", "reason": f"{p}reason",
        "x": {f.name: f"{p}x_{f.name}" for f in fields},
        "t": {f.name: f"{p}t_{f.name}" for f in fields},
        "c": {f.name: f"{p}c_{f.name}" for f in fields},
        "val": {f.name: f"{p}val_{f.name}" for f in fields},
        "ok": {f.name: f"{p}ok_{f.name}" for f in fields},
    }


def _stages(agent: str, raw: str, out: str) -> dict:
    """The staged column lists of one agent's parse.  They reference columns
    by name only, so they are built once per session and reused."""
    key = (SparkSession.getActiveSession()._jsparkSession.sessionUUID(), agent, raw, out)
    cached = _STAGE_CACHE.get(key)
    if cached is not None:
        return cached
    fields = AGENT_FIELDS[agent]
    n = _names(agent, out)
    stages = {"names": n}
    stages["v"] = [J.parse(F.col(raw)).alias(n["v"])]
    stages["x"] = [J.field(F.col(n["v"]), f.name).alias(n["x"][f.name]) for f in fields]
    stages["t"] = [J.jtype(F.col(n["x"][f.name])).alias(n["t"][f.name]) for f in fields]
    stages["c"] = [
        J.KINDS[f.kind](F.col(n["x"][f.name]), F.col(n["t"][f.name]))[0].alias(n["c"][f.name]) for f in fields
    ]
    okval = []
    for f in fields:
        accepted = F.col(n["x"][f.name]).isNull() | F.col(n["c"][f.name]).isNotNull()
        if f.kind.startswith("opt_"):
            accepted = accepted | (F.col(n["t"][f.name]) == "VOID")
        okval.append(F.coalesce(accepted, F.lit(False)).alias(n["ok"][f.name]))
        okval.append(
            F.when(F.col(n["x"][f.name]).isNull(), _default(f)).otherwise(F.col(n["c"][f.name]))
            .cast(J.SQL_TYPES[f.kind]).alias(n["val"][f.name])
        )
    stages["okval"] = okval
    delta = F.col(n["val"]["risk_delta"])
    checks = [(f"INVALID_{f.name.upper()}", F.col(n["ok"][f.name])) for f in fields]
    checks.append(("RISK_DELTA_OUT_OF_RANGE", F.coalesce((delta >= -1.0) & (delta <= 1.0), F.lit(False))))
    stages["reason"] = [_reason(F.col(n["v"]), checks, F.col(raw)).alias(n["reason"])]
    accepted_all = F.col(n["reason"]).isNull()
    cols = [F.lit(K.AGENT_DISPLAY_NAMES[agent]).alias("agent_name")]
    for f in fields:
        if f.name == "status":
            err = F.lit("ERROR")
        elif f.name == "findings":
            err = F.array(F.concat(F.lit(K.ERROR_FINDING_PREFIX), F.col(n["reason"])))
        else:
            err = _lit(f.error_default, f.kind) if f.kind != "str_list" else F.array().cast("array<string>")
        cols.append(F.when(accepted_all, F.col(n["val"][f.name])).otherwise(err).alias(f.name))
    cols.append(F.when(accepted_all, F.col(raw)).alias("raw_response"))
    cols.append(F.col(n["reason"]).alias("error_reason"))
    stages["result"] = F.struct(*cols).alias(out)
    _STAGE_CACHE[key] = stages
    return stages


def with_agent_results(df: DataFrame, specs: list[tuple[str, str, str]]) -> DataFrame:
    """Add one typed result column per ``(agent, raw_text_column, out_column)``.

    Staged projections, so each piece is computed once per row: parse each
    text to a VARIANT; extract every field and its JSON type; coerce each
    field; derive the per-field acceptance flags and the first failing reason;
    assemble the structs.  Each stage is one ``select`` for all agents (few
    plan analyses), and Spark keeps the stages apart because every staged value
    is referenced several times.
    """
    base_cols = list(df.columns)
    built = [_stages(*spec) for spec in specs]
    current = [F.col(c) for c in base_cols]
    staged = df
    for stage in ("v", "x", "t", "c", "okval", "reason"):
        new_cols = [c for b in built for c in b[stage]]
        staged = staged.select(*current, *new_cols)
        current = current + [F.col(name) for name in staged.columns[len(current):]]
    outs = {out for _, _, out in specs}
    keep = [F.col(c) for c in base_cols if c not in outs]
    return staged.select(*keep, *[b["result"] for b in built])


def reply_parse(replies: DataFrame, agent: str, claims: DataFrame | None = None) -> DataFrame:
    """Parse the replies of one agent: ``(claim_id, result)``.

    ``claims`` (claim_id, value_pct_change, has_lien, state) supplies the
    claim-dependent defaults.  When given, the result has one row per claim: a
    claim without a reply is an ERROR (``NO_REPLY``); replies without a claim
    are listed by ``unclaimed_replies``.
    """
    rows = first_replies(replies.filter(F.col("agent") == agent))
    if claims is not None:
        rows = claims.select("claim_id", "value_pct_change", "has_lien", "state").join(
            rows.select("claim_id", "raw_response"), "claim_id", "left"
        )
    else:
        rows = rows.withColumns(
            {"value_pct_change": F.lit(None).cast("double"), "has_lien": F.lit(None).cast("boolean"),
             "state": F.lit(None).cast("string")}
        )
    return with_agent_result(rows, agent, "raw_response", "result").select("claim_id", "result")


RESULT_COLUMNS = {
    "identity": "identity_result",
    "property": "property_result",
    "claims_pattern": "claims_pattern_result",
    "compliance": "compliance_result",
}


def reply_columns(replies: DataFrame) -> list[str]:
    return [c for c in ("claim_id", "agent", "raw_response", "turn") if c in replies.columns]


def _arrival(replies: DataFrame) -> Column:
    """Order of several replies of one agent to one claim: turn if known, then text."""
    return F.struct(*[F.col(c) for c in ("turn", "raw_response") if c in replies.columns])


def first_replies(replies: DataFrame) -> DataFrame:
    """(claim_id, agent, raw_response): the first reply with a text of each claim and agent."""
    order = F.when(F.col("raw_response").isNotNull(), _arrival(replies))
    return replies.groupBy("claim_id", "agent").agg(F.min_by("raw_response", order).alias("raw_response"))


def repeated_replies(replies: DataFrame) -> DataFrame:
    """The quarantine of replies: texts of a claim and agent beyond the first (nothing is dropped silently)."""
    w = Window.partitionBy("claim_id", "agent").orderBy(_arrival(replies))
    nth = replies.filter(F.col("raw_response").isNotNull()).withColumn("reply_number", F.row_number().over(w))
    return nth.filter(F.col("reply_number") > 1)


def unclaimed_replies(replies: DataFrame, claims: DataFrame) -> DataFrame:
    """Replies whose claim is not in ``claims``."""
    return replies.join(claims.select("claim_id"), "claim_id", "left_anti")


def reply_texts(replies: DataFrame, include_synthesis: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per claim with the reply text of each agent (``identity_result``
    ... as text) and ``synthesis_raw``: a pivot over the fixed agent list in
    one aggregation keyed by claim_id.  Of several replies of one agent the
    first counts (``repeated_replies`` lists the others); NULL where there is none."""
    has_text = F.col("raw_response").isNotNull()

    def first_of(agent: str) -> Column:
        return F.min_by("raw_response", F.when((F.col("agent") == agent) & has_text, _arrival(replies)))

    aggs = [first_of(agent).alias(out) for agent, out in RESULT_COLUMNS.items()]
    if include_synthesis:
        aggs.append(first_of(K.ORCHESTRATOR_AGENT).alias("synthesis_raw"))
    aggs += [F.first(c).alias(c) for c in carry]
    return replies.groupBy("claim_id").agg(*aggs)


def parse_texts(df: DataFrame, include_synthesis: bool = True) -> DataFrame:
    """Replace each agent text column by its typed result struct; a missing
    reply is an ERROR result (``NO_REPLY``), a missing synthesis stays NULL and
    gets the fallback decision."""
    return with_agent_results(df, [(a, out, out) for a, out in RESULT_COLUMNS.items()])


def agents_pivot(replies_with_claims: DataFrame, include_synthesis: bool = True) -> DataFrame:
    """Four (or five) replies per claim -> one row per claim with a result
    struct per agent (``identity_result`` ...) and ``synthesis_raw``.

    Input rows carry claim_id, agent, raw_response and the claim columns used
    for defaults (value_pct_change, has_lien, state ...), which are carried
    through the per-claim aggregation.
    """
    claim_cols = tuple(c for c in replies_with_claims.columns if c not in ("claim_id", "agent", "raw_response", "turn"))
    return parse_texts(reply_texts(replies_with_claims, include_synthesis, carry=claim_cols), include_synthesis)


def common_result(col: str) -> Column:
    """The fields every agent result shares (so the four can share one array)."""
    return F.struct(*[F.col(f"{col}.{n}").alias(n) for n in ("agent_name", "status", "findings", "risk_delta",
                                                               "recommendation", "error_reason")])


def reply_error_rows(parsed: DataFrame) -> DataFrame:
    """Agent results that ended in ERROR: (claim_id, agent_name, error_reason, finding)."""
    structs = [common_result(c) for c in RESULT_COLUMNS.values()]
    return (
        parsed.select("claim_id", F.explode(F.array(*structs)).alias("r"))
        .filter(F.col("r.status") == "ERROR")
        .select("claim_id", "r.agent_name", "r.error_reason", F.element_at("r.findings", 1).alias("finding"))
    )
