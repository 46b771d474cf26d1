"""Data-quality checks over the layers, as check rows.

Every check is a row ``(section, check, passed, detail)``; one aggregate per
table computes all of its statistics (no job per column), and a missing table
is a failed check rather than an exception.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimscope import constants as K
from claimscope.functions.aggregates import count_if, exact_avg

CHECK_SCHEMA = T.StructType(
    [
        T.StructField("section", T.StringType()),
        T.StructField("check", T.StringType()),
        T.StructField("passed", T.BooleanType()),
        T.StructField("detail", T.StringType()),
    ]
)


@dataclass
class Measured:
    """A written layer as its checks see it: its columns, and one row of statistics (``rows`` and
    :func:`layer_aggregates`) that the write gathered, so that no check reads the layer again."""

    columns: list[str]
    stats: DataFrame

    @classmethod
    def of(cls, spark: SparkSession, columns: Sequence[str], values: Mapping[str, Any]) -> Measured:
        return cls(list(columns), spark.range(0, 1, 1, 1).select(*[F.lit(v).alias(k) for k, v in values.items()]))

    @property
    def sparkSession(self) -> SparkSession:
        return self.stats.sparkSession


def layer_aggregates(columns: Sequence[str], not_null: Sequence[str] = K.DQ_NOT_NULL_COLUMNS) -> list[Column]:
    """The aggregates behind every check of a scored layer, as far as it has the columns."""
    present = set(columns)
    aggs = []
    if {"fraud_risk_score", "risk_tier"} <= present:
        aggs += [
            F.min("fraud_risk_score").alias("min_score"), F.max("fraud_risk_score").alias("max_score"),
            count_if(F.col("risk_tier") == "HIGH").alias("high_count"),
            count_if(F.col("risk_tier") == "MEDIUM").alias("med_count"),
        ]
    aggs += [count_if(F.col(c).isNull()).alias(f"null_{c}") for c in not_null if c in present]
    if "claim_velocity_24mo" in present:
        aggs.append(F.max("claim_velocity_24mo").alias("max_velocity"))
    return aggs


def _fmt3(c: Column) -> Column:
    return F.format_number(F.round(c.cast("decimal(20,6)"), 3), 3)


def dq_row_count_range(
    tables: Mapping[str, DataFrame | Measured | None],
    ranges: Mapping[str, tuple[int, int]] = K.DQ_ROW_RANGES,
) -> DataFrame:
    """One row per table: (table_name, row_count, lo, hi, passed); a None
    table (missing) gives row_count NULL and passed false, a measured one is not read."""
    parts = []
    spark = None
    for name, (lo, hi) in ranges.items():
        df = tables.get(name)
        if df is None:
            continue
        spark = df.sparkSession
        counted = df.stats if isinstance(df, Measured) else df.agg(F.count(F.lit(1)).alias("rows"))
        parts.append(
            counted.select(
                F.lit(name).alias("table_name"), F.col("rows").cast("bigint").alias("row_count"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")
            )
        )
    missing = [(n, None, lo, hi) for n, (lo, hi) in ranges.items() if tables.get(n) is None]
    if missing:
        if spark is None:
            spark = SparkSession.getActiveSession()
        parts.append(spark.createDataFrame(missing, "table_name string, row_count bigint, lo int, hi int"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    passed = F.coalesce((F.col("row_count") >= F.col("lo")) & (F.col("row_count") <= F.col("hi")), F.lit(False))
    return out.withColumn("passed", passed)


def dq_score_stats(gold: DataFrame) -> DataFrame:
    """min, max, average score, HIGH and MEDIUM counts, total (one pass)."""
    return gold.agg(
        F.min("fraud_risk_score").alias("min_score"),
        F.max("fraud_risk_score").alias("max_score"),
        exact_avg("fraud_risk_score", 3).alias("avg_score"),
        count_if(F.col("risk_tier") == "HIGH").alias("high_count"),
        count_if(F.col("risk_tier") == "MEDIUM").alias("med_count"),
        F.count(F.lit(1)).alias("total"),
    )


def dq_score_checks(gold: DataFrame, min_high_share: float = K.DQ_MIN_HIGH_SHARE) -> DataFrame:
    """Score range 0..1, HIGH share at least ``min_high_share``, MEDIUM populated."""
    s = dq_score_stats(gold)
    share_ok = (F.col("high_count") >= F.lit(min_high_share) * F.col("total")) & (F.col("total") > 0)
    return s.select(
        F.coalesce((F.col("min_score") >= 0) & (F.col("max_score") <= 1), F.lit(False)).alias("score_range_ok"),
        F.coalesce(share_ok, F.lit(False)).alias("high_share_ok"),
        (F.col("med_count") > 0).alias("medium_populated"),
        "min_score", "max_score", "high_count", "med_count", "total",
    )


def dq_null_counts(df: DataFrame, columns: Sequence[str] = K.DQ_NOT_NULL_COLUMNS) -> DataFrame:
    """NULLs per column from one aggregate, unpivoted to (column_name, null_count)."""
    agg = df.agg(*[count_if(F.col(c).isNull()).alias(c) for c in columns])
    return agg.unpivot([], list(columns), "column_name", "null_count")


def dq_velocity_max(gold: DataFrame) -> DataFrame:
    """Largest velocity, and whether it exceeds 1 (the window produced counts)."""
    return gold.agg(F.max("claim_velocity_24mo").alias("max_velocity")).withColumn(
        "passed", F.coalesce(F.col("max_velocity") > 1, F.lit(False))
    )


def _check(check: str, passed: Column, detail: Column) -> Column:
    return F.struct(F.lit(check).alias("check"), F.coalesce(passed, F.lit(False)).alias("passed"),
                    detail.alias("detail"))


def dq_report(
    tables: Mapping[str, DataFrame | Measured | None],
    gold_name: str = "gold_claims_fraud_scored",
    ranges: Mapping[str, tuple[int, int]] = K.DQ_ROW_RANGES,
    required: Sequence[str] = K.DQ_REQUIRED_GOLD_COLUMNS,
    not_null: Sequence[str] = K.DQ_NOT_NULL_COLUMNS,
    min_high_share: float = K.DQ_MIN_HIGH_SHARE,
) -> DataFrame:
    """All checks as rows (section, check, passed, detail).

    Sections: row_counts, schema, score_distribution, nulls, velocity.  Every
    check of the gold table comes from ONE aggregate (row count, score range,
    tier counts, NULLs per column, velocity maximum); each other table is read
    once for its row count.  Tables given as :class:`Measured` are not read at all (their NULL
    counts must be those of ``not_null``).  Use ``dq_summary`` for the failed total.
    """
    gold = tables.get(gold_name)
    others = {n: df for n, df in tables.items() if n != gold_name or gold is None}
    counts = dq_row_count_range(others, {n: r for n, r in ranges.items() if n in others or tables.get(n) is None})
    parts = [
        counts.select(
            F.lit("row_counts").alias("section"),
            F.col("table_name").alias("check"),
            "passed",
            F.when(F.col("row_count").isNull(), F.lit("table missing"))
            .otherwise(F.concat(F.format_number(F.col("row_count"), 0), F.lit(" rows")))
            .alias("detail"),
        )
    ]
    if gold is None:
        parts.append(counts.sparkSession.createDataFrame(
            [("schema", "gold schema readable", False, "table missing")], CHECK_SCHEMA))
    else:
        present = set(gold.columns)
        parts.append(gold.sparkSession.createDataFrame(
            [("schema", f"column {c}", c in present, None) for c in required], CHECK_SCHEMA))
        nulls = [c for c in not_null if c in present]
        has_score = "fraud_risk_score" in present and "risk_tier" in present
        has_vel = "claim_velocity_24mo" in present
        # one pass over gold for every gold check, or none
        stats = gold.stats if isinstance(gold, Measured) else gold.agg(F.count(F.lit(1)).alias("rows"), *layer_aggregates(gold.columns, nulls))
        total = F.col("rows").cast("bigint")
        checks = []
        if gold_name in ranges:
            lo, hi = ranges[gold_name]
            checks.append(("row_counts", _check(gold_name, (total >= lo) & (total <= hi),
                                                F.concat(F.format_number(total, 0), F.lit(" rows")))))
        if has_score:
            share_ok = (F.col("high_count") >= F.lit(min_high_share) * total) & (total > 0)
            checks += [
                ("score_distribution", _check(
                    "score range 0-1", (F.col("min_score") >= 0) & (F.col("max_score") <= 1),
                    F.concat(F.lit("min="), _fmt3(F.col("min_score")), F.lit(" max="), _fmt3(F.col("max_score"))))),
                ("score_distribution", _check(
                    "HIGH tier share", share_ok,
                    F.concat(F.col("high_count").cast("string"), F.lit("/"), total.cast("string")))),
                ("score_distribution", _check(
                    "MEDIUM tier populated", F.col("med_count") > 0,
                    F.concat(F.col("med_count").cast("string"), F.lit(" claims")))),
            ]
        checks += [
            ("nulls", _check(f"no NULLs in {c}", F.col(f"null_{c}") == 0,
                             F.concat(F.col(f"null_{c}").cast("string"), F.lit(" NULLs"))))
            for c in nulls
        ]
        if has_vel:
            checks.append(("velocity", _check(
                "velocity above 1 exists", F.col("max_velocity") > 1,
                F.concat(F.lit("max velocity = "), F.col("max_velocity").cast("string")))))
        rows = F.array(*[F.struct(F.lit(sec).alias("section"), c.alias("c")) for sec, c in checks])
        parts.append(
            stats.select(F.explode(rows).alias("r"))
            .select(F.col("r.section").alias("section"), "r.c.check", "r.c.passed", "r.c.detail")
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dq_summary(report: DataFrame) -> DataFrame:
    """Checks passed and failed in a report (one row)."""
    return report.agg(
        count_if(F.col("passed")).alias("passed_checks"),
        count_if(~F.col("passed")).alias("failed_checks"),
    )


def label_distribution(claims: DataFrame) -> DataFrame:
    """Claims per fraud label."""
    return claims.groupBy("fraud_label").agg(F.count(F.lit(1)).alias("claim_count"))
