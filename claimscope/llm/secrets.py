"""Secret scan over an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its text.  A blob is scanned once per
rule version: blobs and rule versions that the ledger already has are left out, and findings are
joined back to all paths and versions that hold the blob.  Only DataFrame functions are used.

Positions: `split` and `regexp_extract_all` walk a text with the same leftmost, non-overlapping
matches, so the running lengths of the pieces between and of the matches give each span in code
points.

Skew: a blob that a third of all versions hold is one row in the ledger; the join back reads
written tables, whose hot partitions can be split.

Edge cases: null text reads as empty; very long texts are scanned whole; repeated rows and ties
are findings of the same blob; an empty table or an empty ledger gives empty results; only the
named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.llm.common import shared_path, table, written


@dataclass(frozen=True)
class Rule:
    """``group`` must have ``least`` characters, else the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The base kinds in their order. For hex and access the least length is part of the
# pattern: their classes' runs are maximal, so a longer run matches as the dropped short ones would.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: More kinds, of public credential formats.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,15}://[^\s:/@]{1,64}:[^\s:/@]{1,64}@"),
)
RULES = BASE_RULES + MORE_RULES
RULE_VERSION = 1

_SPAN = "array<struct<start:bigint,rank:int,kind:string,stop:bigint>>"


def rule_spans(text: Column, rule: Rule, rank: int) -> Column:
    """The rule's spans in ``text``: array of (start, rank, kind, stop)."""
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    groups = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else matches
    between = F.split(text, rule.pattern, -1)
    zipped = F.arrays_zip(F.slice(between, 1, F.size(matches)).alias("b"), matches.alias("m"), groups.alias("g"))
    walked = F.aggregate(
        zipped,
        F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(None).cast(_SPAN).alias("spans")).withField("spans", F.array().cast(_SPAN)),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["b"]) + F.length(x["m"])).alias("at"),
            F.when(
                F.length(x["g"]) >= rule.least,
                F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(x["b"])).alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), (acc["at"] + F.length(x["b"]) + F.length(x["m"])).alias("stop")))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return F.when(text.rlike(rule.pattern), walked).otherwise(F.array().cast(_SPAN))


def versions(docs: DataFrame, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(path, blob) of every version, with its text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(path_col).alias("path"), text.alias("text")).select("path", F.sha2("text", 256).alias("blob"), "text")


class Ledger:
    """Findings by blob and rule version, kept as Parquet below ``path``; each scan adds one batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    SCHEMA = f"blob string, rule_version int, spans {_SPAN}"

    def findings(self) -> DataFrame:
        # an empty first batch, so that a new ledger can be read
        self.spark.createDataFrame([], self.SCHEMA).write.mode("ignore").parquet(f"{self.path}/scanned")
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/scanned")

    def scan(self, found: DataFrame, rules: tuple[Rule, ...] = RULES, rule_version: int = RULE_VERSION) -> None:
        """Scan the blobs among ``found`` (of :func:`versions`) that this rule version hasn't seen."""
        light = found.select("blob", "path")
        reps = light.groupBy("blob").agg(F.min(F.struct(F.col("path").isNull().alias("none"), "path")).alias("m"))
        reps = reps.select("blob", F.col("m.path").alias("path"))
        seen = self.findings().filter(F.col("rule_version") == rule_version).select("blob")
        reps = written(reps.join(seen, "blob", "left_anti"), "unseen-blobs")
        # one text of each unseen blob; a path without a value is compared null-safely
        texts = found.join(reps, (found.blob == reps.blob) & found.path.eqNullSafe(reps.path), "left_semi")
        spans = F.array_sort(F.concat(*[rule_spans(F.col("text"), r, k) for k, r in enumerate(rules)]))
        new = texts.select("blob", F.lit(rule_version).alias("rule_version"), spans.alias("spans"))
        new = new.groupBy("blob", "rule_version").agg(F.max("spans").alias("spans"))  # repeated rows of one path
        new.write.mode("append").parquet(f"{self.path}/scanned")

    def by_path(self, found: DataFrame, rule_version: int = RULE_VERSION) -> DataFrame:
        """The findings of every version: path, blob, spans (empty where nothing was found)."""
        hits = self.findings().filter((F.col("rule_version") == rule_version) & (F.size("spans") > 0)).select("blob", "spans")
        empty = F.array().cast(_SPAN)
        return found.select("path", "blob").join(hits, "blob", "left").select("path", "blob", F.coalesce("spans", empty).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = versions(table(spark, sf_dir, "documents"))
    ledger = Ledger(spark, shared_path(spark, "secrets"))
    ledger.scan(found)
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_RULES))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return ledger.by_path(found).select(
        F.col("path").alias("doc_id"), *[count(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES],
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )
