"""Table access: named tables and parquet folders as DataFrames."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

TEST_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a scale-factor folder (lazy; column pruning and
    filter pushdown reach the scan through Catalyst).  The folder is listed
    anew by every call."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def scan_table(spark: SparkSession, name: str, path: str | None = None, fmt: str = "parquet") -> DataFrame:
    """A catalog table by name, or a table stored at ``path`` in ``fmt``."""
    if path is None:
        return spark.table(name)
    return spark.read.format(fmt).load(path)


def table_exists(spark: SparkSession, name: str, path: str | None = None) -> bool:
    """True when the catalog table (or the stored folder) exists."""
    if path is None:
        return spark.catalog.tableExists(name)
    try:
        spark.read.parquet(path).schema
        return True
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return False
