"""Sinks: full refresh, append with schema evolution, JSON reports, row counts.

Writes go to storage shared by the cluster (tables in the catalog, or paths
under the folder named by ``spark.checkpoint.dir``); a written table is also
how long lineages are cut, so a lost executor only recomputes from it.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, DataFrameWriter, Observation, SparkSession
from pyspark.sql import functions as F

from claimscope.session import scratch_path

RUN = "run"  # partition column of appended tables
_RUN_ID = re.compile(r"[A-Za-z][A-Za-z0-9_.-]*")  # never read back as a number or a date


def with_lookup(writer: DataFrameWriter, columns: Sequence[str], distinct: int | None = None) -> DataFrameWriter:
    """Parquet bloom filters on ``columns``: an equality filter on one of them skips the row groups
    that don't hold the value, whatever the table is sorted by."""
    for c in columns:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        if distinct:
            writer = writer.option(f"parquet.bloom.filter.expected.ndv#{c}", str(distinct))
    return writer


def sink_measured(
    df: DataFrame,
    path: str | None = None,
    table: str | None = None,
    fmt: str = "parquet",
    partition_by: list[str] | None = None,
    bucket_by: tuple[int, str] | None = None,
    lookup: Sequence[str] = (),
    measures: Sequence[Column] = (),
) -> dict[str, Any]:
    """Full refresh (schema replaced).  Returns ``rows``, the rows written, and the named aggregates
    ``measures`` over them, gathered by an observation in the tasks that write (no second scan; a
    task that is repeated counts once).

    With ``table`` the rows go to a catalog table (stored at ``path`` when both
    are given); ``bucket_by`` (number, column) buckets and sorts it, so that
    tables of equal buckets join on the column without an exchange."""
    obs = Observation("rows_written")
    observed = df.observe(obs, F.count(F.lit(1)).alias("rows"), *measures)
    writer = with_lookup(observed.write.mode("overwrite").format(fmt), lookup)
    if fmt == "delta":
        writer = writer.option("overwriteSchema", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if table is not None:
        if bucket_by:
            writer = writer.bucketBy(*bucket_by).sortBy(bucket_by[1])
        if path is not None:
            writer = writer.option("path", path)
        writer.saveAsTable(table)
    elif bucket_by:
        raise ValueError("bucket_by needs a table name: only the catalog knows a table's buckets")
    else:
        writer.save(path)
    return obs.get


def sink_overwrite(
    df: DataFrame,
    path: str | None = None,
    table: str | None = None,
    fmt: str = "parquet",
    partition_by: list[str] | None = None,
    bucket_by: tuple[int, str] | None = None,
    lookup: Sequence[str] = (),
) -> int:
    """:func:`sink_measured` without measures: the number of rows written."""
    return int(sink_measured(df, path, table, fmt, partition_by, bucket_by, lookup)["rows"])


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: the lineage is cut, and joins
    plan with its measured size."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def run_folder(path: str, run_id: str) -> str:
    if not _RUN_ID.fullmatch(run_id):
        raise ValueError(f"a run id starts with a letter and has letters, digits, '.', '_' and '-' only: {run_id!r}")
    return f"{path.rstrip('/')}/{RUN}={run_id}"


def sink_append_evolving(df: DataFrame, path: str, fmt: str = "parquet", run_id: str | None = None) -> None:
    """Append one run's rows; new columns are allowed (readers merge schemas,
    see ``read_evolving``).

    With ``run_id`` the rows are the partition ``run=<id>``, which replaces what an
    earlier attempt of the same run left there: a repeated run never doubles
    rows.  The partition is overwritten by name, not dynamically, since a
    repetition without rows must replace the earlier ones, too."""
    writer = df.drop(RUN).write.mode("overwrite" if run_id else "append").format(fmt)
    if fmt == "delta":
        writer = writer.option("mergeSchema", "true")
    writer.save(run_folder(path, run_id) if run_id else path)


def sink_append_table(df: DataFrame, table: str, run_id: str, bucket_by: tuple[int, str] | None = None, path: str | None = None) -> None:
    """The same for a catalog table, partitioned by run (and bucketed): created by the first run;
    new columns are added to it, absent ones are NULL."""
    spark = df.sparkSession
    run_folder("", run_id)  # a valid id
    rows = df.drop(RUN)
    if not spark.catalog.tableExists(table):
        writer = rows.limit(0).withColumn(RUN, F.lit(run_id)).write.format("parquet").partitionBy(RUN)
        if bucket_by:
            writer = writer.bucketBy(*bucket_by).sortBy(bucket_by[1])
        if path is not None:
            writer = writer.option("path", path)
        writer.saveAsTable(table)
    have = spark.table(table).schema
    new = [f for f in rows.schema if f.name not in have.names]
    if new:
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in new)})")
        have = spark.table(table).schema
    columns = [F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in have if f.name != RUN]
    view = f"append_{uuid.uuid4().hex}"
    rows.select(*columns).createOrReplaceTempView(view)
    try:
        spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION ({RUN}='{run_id}') SELECT * FROM {view}")
    finally:
        spark.catalog.dropTempView(view)


def read_evolving(spark: SparkSession, path: str, but_run: str | None = None) -> DataFrame:
    """Read an appended parquet folder with merged schemas (columns missing in
    older files read as NULL), without the rows of run ``but_run``."""
    rows = spark.read.option("mergeSchema", "true").parquet(path)
    return rows.filter(F.col(RUN) != but_run) if but_run and RUN in rows.columns else rows


def not_logged(rows: DataFrame, log: DataFrame | None) -> DataFrame:
    """Rows that no earlier run has logged alike (in all columns of both)."""
    if log is None:
        return rows
    alike = [c for c in rows.columns if c in log.columns and c != RUN]
    old = log.select(*[F.col(c).alias(f"old_{c}") for c in alike])
    same = [F.col(c).eqNullSafe(F.col(f"old_{c}")) for c in alike]
    return rows.join(old, same, "left_anti")


def align_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union by column name, filling columns missing on either side with NULL."""
    return a.unionByName(b, allowMissingColumns=True)


def sink_report_json(reports: DataFrame, path: str, run_id: str | None = None) -> None:
    """One JSON document per report (JSON lines; nested structs and arrays kept),
    written in parallel by the executors; with ``run_id`` as a partition that a
    repeated run replaces."""
    if run_id:
        reports.write.mode("overwrite").json(run_folder(path, run_id))
    else:
        reports.write.mode("append").json(path)


def rows_after_write(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Rows of a written table (one row, ``row_count``)."""
    return spark.read.format(fmt).load(path).agg(F.count(F.lit(1)).alias("row_count"))
