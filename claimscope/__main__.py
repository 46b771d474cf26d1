"""Command line: batch refresh, data-quality report, investigation queue and run.

    python -m claimscope refresh --out DIR (--sf-dir DIR | --claims PATH --claimants PATH --properties PATH [--format csv])
                                 [--as-of YYYY-MM-DD] [--high X] [--medium X] [--replies PATH|TABLE]
    python -m claimscope quality --out DIR
    python -m claimscope queue --out DIR [--dry-run] [--claim-id ID] [--high X] [--min-amount X]
    python -m claimscope investigate --out DIR --replies PATH|TABLE [--run-id ID] [--high X] [--min-amount X]

Every command takes ``--database NAME``: the layers and the audit log are then tables of
that database, stored below ``--out`` and bucketed by claim_id.

``--out`` is the folder of the written layers (a refresh writes ``bronze_*``,
``silver_claims_enriched``, ``gold_claims_fraud_scored`` there).  A refresh with
``--replies`` goes on with the investigation.  CSV and JSON lines that can't be
read go to ``bronze_*_rejects``.  An investigation appends
``gold_investigation_audit_log``, writes JSON reports to
``investigation_reports``, and appends what it could not use, whole, to
``investigation_quarantine``, ``investigation_invalid_claims`` and
``investigation_repeated_replies`` (what no earlier run has logged alike).  All of
them are keyed by run: a run that failed is repeated with its ``--run-id``, and
replaces what it left.  ``queue`` and ``quality`` write their whole
result to ``investigation_queue`` and ``quality_report``.  Replies are a parquet
table ``(claim_id, agent, raw_response[, turn])``.
"""

from __future__ import annotations

import argparse
import datetime as dt
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession


def _session() -> SparkSession:
    from claimscope.session import SESSION_DEFAULTS, ensure_checkpoint_dir

    builder = SparkSession.builder.appName("claimscope")
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def _read_if_there(spark: SparkSession, path: str, but_run: str | None = None) -> DataFrame | None:
    from claimscope.sources.sinks import read_evolving
    from claimscope.sources.tables import table_exists

    return read_evolving(spark, path, but_run) if table_exists(spark, "", path) else None


def _layer(spark: SparkSession, args: argparse.Namespace, name: str) -> DataFrame | None:
    """A written layer, by name in the database or by its folder."""
    from claimscope.sources.tables import table_exists

    if args.database:
        return spark.table(f"{args.database}.{name}") if table_exists(spark, f"{args.database}.{name}") else None
    return _read_if_there(spark, f"{args.out.rstrip('/')}/{name}")


def _audit_log(spark: SparkSession, args: argparse.Namespace, but_run: str | None = None) -> DataFrame | None:
    log = _layer(spark, args, "gold_investigation_audit_log")
    return log.filter(log["run"] != but_run) if log is not None and but_run else log


def _parser() -> argparse.ArgumentParser:
    from claimscope import constants as K

    parser = argparse.ArgumentParser(prog="claimscope")
    sub = parser.add_subparsers(dest="cmd", required=True)

    def command(name: str, text: str, *, thresholds: bool = False) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=text)
        p.add_argument("--out", required=True)
        p.add_argument("--database", help="the layers are tables of this database")
        if thresholds:
            p.add_argument("--high", type=float, default=K.HIGH_THRESHOLD)
            p.add_argument("--min-amount", type=float, default=K.ALERT_AMOUNT_MIN)
        return p

    p = command("refresh", "bronze -> silver -> gold, and on to the investigation with --replies", thresholds=True)
    p.add_argument("--sf-dir", help="claims derived from a folder of test tables")
    for name in ("claims", "claimants", "properties"):
        p.add_argument(f"--{name}", help=f"landing folder of {name}")
    p.add_argument("--format", default="parquet", choices=("parquet", "csv", "json"))
    p.add_argument("--as-of", type=dt.date.fromisoformat, default=None)
    p.add_argument("--medium", type=float, default=K.MEDIUM_THRESHOLD)
    p.add_argument("--replies")
    p.add_argument("--run-id")
    command("quality", "data-quality report over written layers")
    p = command("queue", "the pending investigation queue", thresholds=True)
    p.add_argument("--dry-run", action="store_true", help="only the claim ids")
    p.add_argument("--claim-id", default=None)
    p = command("investigate", "parse replies, decide, append audit rows and reports", thresholds=True)
    p.add_argument("--replies", required=True)
    p.add_argument("--run-id", help="the same for a repeated run; a new one by default")
    return parser


def _sources(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, DataFrame, DataFrame]:
    from claimscope.sources import fixtures as FX
    from claimscope.sources import landing as LD

    if args.sf_dir:
        return FX.bronze_claims(spark, args.sf_dir), FX.claimants(spark, args.sf_dir), FX.properties(spark, args.sf_dir)
    if not (args.claims and args.claimants and args.properties):
        raise SystemExit("refresh needs --sf-dir, or --claims, --claimants and --properties")
    return tuple(
        LD.split_landing(spark, path, schema, fmt=args.format)
        for path, schema in (
            (args.claims, LD.BRONZE_CLAIMS_SCHEMA), (args.claimants, LD.CLAIMANTS_SCHEMA),
            (args.properties, LD.PROPERTIES_SCHEMA),
        )
    )


def _investigate(spark: SparkSession, args: argparse.Namespace) -> str:
    from claimscope.plans.investigate import investigate
    from claimscope.plans.refresh import BUCKETS
    from claimscope.sources.sinks import not_logged, sink_append_evolving, sink_append_table, sink_report_json
    from claimscope.sources.tables import table_exists

    out, now = args.out.rstrip("/"), dt.datetime.now(dt.timezone.utc).replace(tzinfo=None, microsecond=0)  # one clock for the run
    run_id = args.run_id or f"r{now:%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:6]}"
    print(f"run {run_id}", flush=True)
    named = "/" not in args.replies and table_exists(spark, args.replies)
    inv = investigate(
        _layer(spark, args, "gold_claims_fraud_scored"), spark.table(args.replies) if named else spark.read.parquet(args.replies),
        min_score=args.high, min_amount=args.min_amount,
        audit_log=_audit_log(spark, args, but_run=run_id), investigated_at=now,
    )
    for name, rows in (
        ("investigation_quarantine", inv.quarantine), ("investigation_invalid_claims", inv.invalid_claims),
        ("investigation_repeated_replies", inv.repeated_replies),
    ):
        path = f"{out}/{name}"
        sink_append_evolving(not_logged(rows, _read_if_there(spark, path, but_run=run_id)), path, run_id=run_id)
    sink_report_json(inv.report, f"{out}/investigation_reports", run_id=run_id)
    # the audit comes last: what is audited isn't queued again
    if args.database:
        sink_append_table(inv.audit, f"{args.database}.gold_investigation_audit_log", run_id, (BUCKETS, "claim_id"), f"{out}/gold_investigation_audit_log")
    else:
        sink_append_evolving(inv.audit, f"{out}/gold_investigation_audit_log", run_id=run_id)
    return run_id


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = _session()
    from claimscope.operators import quality as Q
    from claimscope.operators import queue as QU
    from claimscope.plans.refresh import LAYERS
    from claimscope.sources.sinks import sink_overwrite

    out = args.out.rstrip("/")
    if args.cmd == "refresh":
        from claimscope.plans.refresh import refresh

        res = refresh(spark, *_sources(spark, args), base=out, as_of=args.as_of, high=args.high, medium=args.medium, database=args.database)
        for name, n in res.rows.items():
            print(f"{name}: {n:,} rows")
        if args.replies:
            _investigate(spark, args)
    elif args.cmd == "investigate":
        _investigate(spark, args)
    elif args.cmd == "quality":
        tables = {name: _layer(spark, args, name) for name in LAYERS}
        report = Q.dq_report(tables)
        sink_overwrite(report, f"{out}/quality_report")
        failed = Q.dq_summary(spark.read.parquet(f"{out}/quality_report")).first()["failed_checks"]
        print(f"{failed} failed checks; all checks are in {out}/quality_report")
        return 1 if failed else 0
    else:
        gold = _layer(spark, args, "gold_claims_fraud_scored")
        if args.claim_id:
            QU.claim_lookup(gold, args.claim_id).show(truncate=False)  # one claim
            return 0
        audit = _audit_log(spark, args)
        queue = QU.pending_queue(gold, args.high, args.min_amount, audit=audit)
        n = sink_overwrite(QU.queue_dry_run(queue) if args.dry_run else queue, f"{out}/investigation_queue")
        print(f"{n:,} claims in {out}/investigation_queue")
    return 0


if __name__ == "__main__":
    sys.exit(main())
