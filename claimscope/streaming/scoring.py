"""Structured Streaming: incremental scoring and the hourly alert throttle.

* ``score_stream``: gold scoring is map-only, so it runs unchanged on a
  streaming DataFrame of silver rows.
* ``velocity_batches``: the trailing velocity needs every earlier claim of the
  claimant, which a RANGE window cannot do on a stream; ``foreachBatch`` keeps
  the per-(claimant, day) counts as versioned state under the checkpoint folder
  (bounded by claimants x days, not by claims), adds each micro-batch to it and
  scores the batch's claims against the merged counts.  A retried batch
  rewrites the same state version, so replays are idempotent.
* ``alert_throttle_stream``: at most one alert per hour -- the first breach of
  each tumbling hour, emitted once the watermark passes the hour.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimscope import constants as K
from claimscope.operators.gold import gold_score
from claimscope.operators.silver import cast_filed_date, silver_columns


def score_stream(silver_stream: DataFrame, high: float = K.HIGH_THRESHOLD, medium: float = K.MEDIUM_THRESHOLD,
                 scored_at=None) -> DataFrame:
    """Gold rows for a stream of silver rows (stateless)."""
    return gold_score(silver_stream, high, medium, scored_at=scored_at)


def _latest_state(spark: SparkSession, state_dir: str, before: int) -> DataFrame | None:
    """Daily counts of the newest state version older than ``before`` (state
    is one parquet table partitioned by ``batch``; read through Spark, so any
    shared filesystem works)."""
    try:
        state = spark.read.parquet(state_dir)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    older = state.filter(F.col("batch") < before)
    latest = older.agg(F.max("batch").alias("b")).first()["b"]
    if latest is None:
        return None
    return older.filter(F.col("batch") == latest).drop("batch")


def velocity_batches(
    state_dir: str,
    sink_path: str,
    as_of=None,
    days: int = K.VELOCITY_WINDOW_DAYS,
    high: float = K.HIGH_THRESHOLD,
    medium: float = K.MEDIUM_THRESHOLD,
    scored_at=None,
):
    """A ``foreachBatch`` function: bronze claims micro-batch -> gold rows in
    ``sink_path/batch=<id>`` (a retried batch replaces its own rows); daily
    counts kept under ``state_dir``."""

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        claims = cast_filed_date(batch)
        daily_new = claims.groupBy("claimant_id", "filed_date").agg(F.count("claim_id").alias("n"))
        prev = _latest_state(spark, state_dir, batch_id)
        merged = daily_new if prev is None else prev.unionByName(daily_new)
        merged = merged.groupBy("claimant_id", "filed_date").agg(F.sum("n").cast("bigint").alias("n"))
        version = f"{state_dir.rstrip('/')}/batch={batch_id}"
        merged.write.mode("overwrite").parquet(version)  # a retried batch rewrites its own version
        state = spark.read.parquet(version)
        touched = state.join(claims.select("claimant_id").distinct(), "claimant_id", "left_semi")
        w = Window.partitionBy("claimant_id").orderBy(F.unix_date("filed_date")).rangeBetween(-days, 0)
        vel = touched.select(
            F.col("claimant_id").alias("_c"), F.col("filed_date").alias("_d"),
            F.sum("n").over(w).cast("bigint").alias("claim_velocity_24mo"),
        )
        cond = claims["claimant_id"].eqNullSafe(vel["_c"]) & claims["filed_date"].eqNullSafe(vel["_d"])
        silver = claims.join(vel, cond, "left").drop("_c", "_d").withColumns(silver_columns(as_of))
        gold = gold_score(silver, high, medium, scored_at=scored_at)
        gold.write.mode("overwrite").parquet(f"{sink_path.rstrip('/')}/batch={batch_id}")  # as the state

    return process


def run_velocity_stream(
    bronze_stream: DataFrame,
    base: str,
    as_of=None,
    scored_at=None,
    available_now: bool = True,
):
    """Start the incremental scoring of a bronze claims stream; returns the
    query and the gold sink path (``base/gold``)."""
    sink = os.path.join(base, "gold")
    fn = velocity_batches(os.path.join(base, "velocity_state"), sink, as_of=as_of, scored_at=scored_at)
    writer = bronze_stream.writeStream.foreachBatch(fn).option("checkpointLocation", os.path.join(base, "checkpoint"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start(), sink


def alert_throttle_stream(
    evaluations: DataFrame,
    ts: str = "ts",
    value: str = "value",
    threshold: float = 0,
    period: str = "1 hour",
    watermark: str = "1 hour",
) -> DataFrame:
    """First breach per ``period`` of a stream of measure evaluations
    (append mode: a window is emitted once the watermark passes its end)."""
    # every evaluation (breach or not) must pass the watermark node so event
    # time advances; the breach test sits inside the aggregate, where it cannot
    # be pushed down below the watermark into the scan
    timed = evaluations.withWatermark(ts, watermark)
    breach = F.col(value) > threshold
    first = F.min_by(
        F.when(breach, F.struct(F.col(ts).alias("ts"), F.col(value).alias("value"))), F.when(breach, F.col(ts))
    )
    return (
        timed.groupBy(F.window(ts, period).alias("w"))
        .agg(first.alias("first"))
        .filter(F.col("first").isNotNull())
        .select(
            F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
            F.col("first.ts").alias("alert_ts"), F.col("first.value").alias("alert_value"),
        )
    )
