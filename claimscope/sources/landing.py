"""Landing-zone readers: CSV / JSON / Parquet files with an explicit schema."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"

BRONZE_CLAIMS_SCHEMA = T.StructType(
    [
        T.StructField("claim_id", T.StringType()),
        T.StructField("claimant_id", T.StringType()),
        T.StructField("property_id", T.StringType()),
        T.StructField("claim_type", T.StringType()),
        T.StructField("fraud_label", T.StringType()),
        T.StructField("is_confirmed_fraud", T.BooleanType()),
        T.StructField("claim_amount", T.DoubleType()),
        T.StructField("claim_status", T.StringType()),
        T.StructField("filed_date", T.DateType()),
        T.StructField("resolved_date", T.DateType()),
        T.StructField("assigned_investigator", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("id_verified", T.BooleanType()),
        T.StructField("value_pct_change", T.DoubleType()),
        T.StructField("has_lien", T.BooleanType()),
        T.StructField("account_age_days", T.LongType()),
    ]
)

CLAIMANTS_SCHEMA = T.StructType(
    [
        T.StructField("claimant_id", T.StringType()),
        T.StructField("first_name", T.StringType()),
        T.StructField("last_name", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("ssn_last4", T.StringType()),
        T.StructField("id_verified", T.BooleanType()),
        T.StructField("account_age_days", T.LongType()),
    ]
)

PROPERTIES_SCHEMA = T.StructType(
    [
        T.StructField("property_id", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("county", T.StringType()),
        T.StructField("value_at_closing", T.DoubleType()),
        T.StructField("current_value", T.DoubleType()),
        T.StructField("value_pct_change", T.DoubleType()),
        T.StructField("days_since_closing", T.LongType()),
        T.StructField("has_lien", T.BooleanType()),
    ]
)


def _by_header(reader):
    """A file whose header differs from the schema's names or order fails the read."""
    return reader.option("header", "true").option("enforceSchema", "false")


def _in_header_order(spark: SparkSession, path: str, schema: T.StructType) -> T.StructType:
    """The schema's fields in the order of the files' header: columns are bound by name."""
    header = spark.read.option("header", "true").csv(path).columns
    if sorted(header) != sorted(schema.names):
        raise ValueError(f"the header of {path} has columns {header}, not {schema.names}")
    return T.StructType([schema[name] for name in header])


def read_landing(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    fmt: str = "parquet",
    keep_corrupt: bool = True,
) -> DataFrame:
    """Files of a landing folder with a fixed schema (never inferred).

    CSV and JSON are read PERMISSIVE: a malformed line keeps its text in
    ``_corrupt_record`` (with the other columns NULL) instead of failing the
    job.  Parquet files are read with the schema, so only its columns are
    scanned.
    """
    wanted = schema
    if fmt == "csv":
        schema = _in_header_order(spark, path, schema)
    reader = spark.read.schema(schema)
    if fmt in ("csv", "json"):
        if keep_corrupt:
            schema = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
            reader = spark.read.schema(schema).option("columnNameOfCorruptRecord", CORRUPT)
        reader = reader.option("mode", "PERMISSIVE")
        if fmt == "csv":
            reader = _by_header(reader)
    rows = reader.format(fmt).load(path)
    return rows.select(*wanted.names, *([CORRUPT] if CORRUPT in rows.columns else []))


@dataclass
class Landed:
    """What a landing folder holds: every record is in one of the two."""

    good: DataFrame
    rejects: DataFrame


REJECT_COLUMNS = ("source_file", "reason", "record")


def _header_orders(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """(source_file, header) of the files that have a header line: one with exactly the schema's names,
    in any order.  Repeated headers of a file count once (the least one)."""
    names = F.array(*[F.lit(n) for n in sorted(schema.names)])
    cells = F.transform(F.split("record", ","), lambda c: F.trim(F.btrim(c, F.lit('"'))))
    found = lines.filter(F.array_sort(cells) == names).select("source_file", F.array_join(cells, ",").alias("header"))
    return found.groupBy("source_file").agg(F.min("header").alias("header"))


def _split_csv(spark: SparkSession, path: str, schema: T.StructType) -> Landed:
    """Each line is parsed by the header of its own file, so files may differ in the order of columns."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("record"))
    lines = lines.filter(F.trim("record") != "")
    headers = _header_orders(lines, schema)
    orders = [r["header"] for r in headers.select("header").distinct().orderBy("header").collect()]  # orders, not files
    rows = lines.join(headers, "source_file", "left")
    clean = F.array_join(F.transform(F.split("record", ","), lambda c: F.trim(F.btrim(c, F.lit('"')))), ",")
    rows = rows.filter(F.col("header").isNull() | (clean != F.col("header")))
    kept = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed: Column = F.lit(None).cast(kept)
    for order in orders:
        fields = T.StructType([schema[n] for n in order.split(",")] + [kept[CORRUPT]])
        row = F.from_csv("record", fields.simpleString(), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
        same = F.struct(*[row.getField(n).alias(n) for n in kept.names])
        parsed = F.when(F.col("header") == order, same).otherwise(parsed)
    return _halves(rows.withColumn("parsed", parsed), schema, "header")


def _halves(rows: DataFrame, schema: T.StructType, header: str | None) -> Landed:
    """``rows``: source_file, record, parsed (a struct with the corrupt record)."""
    bad = F.col("parsed").isNull() | F.col(f"parsed.{CORRUPT}").isNotNull()
    reason = F.lit("malformed") if header is None else F.when(F.col(header).isNull(), "no header").otherwise("malformed")
    good = rows.filter(~bad).select(*[F.col(f"parsed.{n}").alias(n) for n in schema.names])
    return Landed(good, rows.filter(bad).select("source_file", reason.alias("reason"), "record"))


def split_landing(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> Landed:
    """Files of a landing folder, split into rows of the schema and rejects (source_file, reason, record).

    CSV and JSON: one record per line; blank lines are none.  A line that doesn't have the schema's
    number and types of values is a reject, with its text and file; every other line is a good row:
    nothing is lost.  CSV columns are bound by each file's own header; all lines of a file without
    one are rejects.  Parquet files have no malformed rows.
    """
    if fmt == "csv":
        return _split_csv(spark, path, schema)
    if fmt == "json":
        lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("record"))
        kept = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        parsed = F.from_json("record", kept, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
        return _halves(lines.filter(F.trim("record") != "").withColumn("parsed", parsed), schema, None)
    none = T.StructType([T.StructField(c, T.StringType()) for c in REJECT_COLUMNS])
    return Landed(read_landing(spark, path, schema, fmt), spark.createDataFrame([], none))


def read_landing_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                        max_files_per_trigger: int | None = None) -> DataFrame:
    """The same landing folder as a file stream (new files become
    micro-batches); malformed CSV and JSON lines are kept as in ``read_landing``."""
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt in ("csv", "json"):
        kept = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
        reader = spark.readStream.schema(kept).format(fmt)
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT).option("mode", "PERMISSIVE")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    if fmt == "csv":
        reader = _by_header(reader)
    return reader.load(path)
