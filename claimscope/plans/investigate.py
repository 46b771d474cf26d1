"""End-to-end investigation as set operations over the gold table and a
replies table: queue -> validate/quarantine -> join replies -> parse + pivot ->
fallback/synthesis -> report, audit rows and quarantine.

Shuffles: the replies are joined to the valid queue on claim_id (AQE
broadcasts the queue side only when its measured size is under the threshold),
and the pivot groups on claim_id, reusing that partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from claimscope import constants as K
from claimscope.operators import decide as D
from claimscope.operators import queue as Qu
from claimscope.operators import replies as R
from claimscope.operators import report as Rp
from claimscope.sources.sinks import stored


def unbounded(df: DataFrame) -> DataFrame:
    """Mark a side whose size grows with the data (replies: five per claim):
    join it by shuffle + sort-merge, never by broadcast.  Both sides are then
    hash-partitioned and sorted on claim_id, which the pivot aggregation on
    claim_id reuses (no further exchange or sort)."""
    return df.hint("merge")


@dataclass
class Investigation:
    queue: DataFrame
    validated: DataFrame
    invalid_claims: DataFrame
    parsed: DataFrame
    decided: DataFrame
    report: DataFrame
    audit: DataFrame
    quarantine: DataFrame
    repeated_replies: DataFrame


def investigate(
    gold: DataFrame,
    replies: DataFrame,
    min_score: float = K.HIGH_THRESHOLD,
    min_amount: float = K.ALERT_AMOUNT_MIN,
    audit_log: DataFrame | None = None,
    investigated_at=None,
    model_version: str = K.MODEL_VERSION,
    store: bool = True,
) -> Investigation:
    """Investigate every pending claim (nothing is collected).

    The valid queue is used twice (to select the replies and to receive the
    parsed results) and the decisions three times (report, audit rows,
    quarantine), so by default both are written to the shared checkpoint
    folder and read back: computed one time each, and a lost executor recomputes
    from there instead of from the source tables.  The written queue has a
    measured size: the planner broadcasts its ids to the scan of the replies
    when they are few, and else may send a bloom filter of them there.
    """
    queue = Qu.pending_queue(gold, min_score, min_amount, audit=audit_log, ordered=False)
    validated = Qu.claim_validate(queue)
    valid = Qu.valid_claims(validated)
    if store:
        valid = stored(valid, "queue")
    # replies of the queued claims only: a semi join can only build its right
    # side (the queue ids), so AQE may broadcast the queue when it is small,
    # and the replies table is never broadcast
    wanted = replies.select(*R.reply_columns(replies)).join(valid.select("claim_id"), "claim_id", "left_semi")
    texts = R.reply_texts(wanted)
    parsed = R.parse_texts(valid.join(texts, "claim_id", "left"))
    decided = D.synthesis_parse(D.decide_fallback(parsed))
    if store:
        # queue-sized and read by the report, the audit rows and the
        # quarantine; downstream joins then plan against a table
        # instead of the large parsing expressions
        decided = stored(decided, "decided")
    report = Rp.investigation_report(decided, investigated_at, model_version)
    return Investigation(
        queue=queue,
        validated=validated,
        invalid_claims=Qu.quarantined_claims(validated),
        parsed=parsed,
        decided=decided,
        report=report,
        audit=Rp.audit_row(report),
        quarantine=Rp.quarantine(decided),
        repeated_replies=R.repeated_replies(wanted),
    )


def parse_all_claims(gold: DataFrame, replies: DataFrame) -> DataFrame:
    """Parsed agent results and the decision of every claim (no queue filter):
    the bulk re-parse of a replies table.  Claims without replies are kept, as
    ERROR results with the fallback decision."""
    claims = gold.select("claim_id", "fraud_risk_score", "claim_amount", "risk_tier", "value_pct_change",
                         "has_lien", "state")
    # pivot the texts first (one shuffle of the replies by claim_id), then a
    # sort-merge join with the claims: both sides grow with the whole claims
    # table, so neither may be broadcast (the texts side is already
    # partitioned and sorted by claim_id)
    texts = R.reply_texts(replies.select(*R.reply_columns(replies)))
    joined = claims.join(unbounded(texts), "claim_id", "left")
    return D.synthesis_parse(D.decide_fallback(R.parse_texts(joined)))
