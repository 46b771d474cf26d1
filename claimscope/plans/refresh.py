"""Batch refresh: bronze -> silver -> gold (clustered) -> data-quality report.

Each layer is written and re-read before the next one, which cuts the
lineage (an executor lost later recomputes from the written layer, not from
the raw tables) and lets each layer be consumed independently.  Paths live
under the shared folder named by ``spark.checkpoint.dir`` unless given.  With a
database the layers are catalog tables; those with a claim per row are bucketed
by claim_id, so that gold, replies and audit join without an exchange.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from claimscope import constants as K
from claimscope.operators.gold import gold_score
from claimscope.operators.quality import Measured, dq_report, layer_aggregates
from claimscope.operators.silver import silver_enrich
from claimscope.plans.layout import layout_cluster
from claimscope.session import scratch_path
from claimscope.sources.landing import Landed
from claimscope.sources.sinks import sink_measured
from claimscope.sources.tables import scan_table

BUCKETS = 8  # of catalog tables with a claim per row; about table size / 256 MB
SCORED = "gold_claims_fraud_scored"
BY_CLAIM = ("bronze_claims_raw", "silver_claims_enriched", SCORED)
LAYERS = (
    "bronze_claims_raw", "bronze_claimants", "bronze_properties", "silver_claims_enriched",
    "gold_claims_fraud_scored",
)


@dataclass
class RefreshResult:
    base: str
    paths: dict[str, str]
    rows: dict[str, int] = field(default_factory=dict)
    database: str | None = None
    buckets: int = BUCKETS
    measured: dict[str, Measured] = field(default_factory=dict)  # by the writes, for the report

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return scan_table(spark, f"{self.database}.{name}", None if self.database else self.paths[name])

    def write(self, df: DataFrame, name: str, bucket_by: str | None = "claim_id") -> None:
        """One layer: a folder, or a catalog table stored in that folder."""
        found = sink_measured(
            df,
            self.paths[name],
            f"{self.database}.{name}" if self.database else None,
            bucket_by=(self.buckets, bucket_by) if self.database and bucket_by else None,
            lookup=(bucket_by,) if bucket_by else (),
            measures=layer_aggregates(df.columns) if name == SCORED else (),
        )
        self.rows[name] = int(found["rows"])
        self.measured[name] = Measured.of(df.sparkSession, df.columns, found)


def refresh(
    spark: SparkSession,
    claims: DataFrame | Landed,
    claimants: DataFrame | Landed,
    properties: DataFrame | Landed,
    base: str | None = None,
    as_of=None,
    scored_at=None,
    high: float = K.HIGH_THRESHOLD,
    medium: float = K.MEDIUM_THRESHOLD,
    cluster: bool = True,
    database: str | None = None,
    buckets: int = BUCKETS,
) -> RefreshResult:
    """Run the whole refresh; returns the written paths and row counts.  Sources that were split
    (:func:`split_landing`) also leave ``<layer>_rejects``.  The clustered layout is for folders;
    catalog tables are laid out by their buckets."""
    base = base or scratch_path(spark, f"refresh-{uuid.uuid4().hex[:12]}")
    bronze = {"bronze_claims_raw": claims, "bronze_claimants": claimants, "bronze_properties": properties}
    rejects = [f"{name}_rejects" for name, rows in bronze.items() if isinstance(rows, Landed)]
    res = RefreshResult(base, {name: os.path.join(base, name) for name in (*LAYERS, *rejects)}, database=database, buckets=buckets)
    if database:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, rows in bronze.items():
        if isinstance(rows, Landed):
            res.write(rows.rejects, f"{name}_rejects", None)
            rows = rows.good
        res.write(rows, name, "claim_id" if name in BY_CLAIM else None)
    silver = silver_enrich(res.read(spark, "bronze_claims_raw"), as_of=as_of)
    res.write(silver, "silver_claims_enriched")
    gold = gold_score(res.read(spark, "silver_claims_enriched"), high, medium, scored_at=scored_at)
    res.write(layout_cluster(gold) if cluster and not database else gold, "gold_claims_fraud_scored")
    return res


def refresh_report(spark: SparkSession, res: RefreshResult) -> DataFrame:
    """The data-quality report of the refresh, from what its writes measured: no layer is read
    (but one that this result has only the path of)."""
    return dq_report({name: res.measured.get(name) or res.read(spark, name) for name in LAYERS})
