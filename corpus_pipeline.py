"""A training-data pipeline over ``documents``: filter, clean, deduplicate, decontaminate, tokenise.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the columns of
``documents`` (the last one returns token ids).  ``run`` writes every stage's result to the shared
folder and reads it again, so a lost executor never repeats an earlier stage.

Null and empty texts pass every stage (nothing is found in them); rows that share a doc_id are
duplicates only when their texts are near copies, and rows without a doc_id never; empty
tables give empty results; columns beyond those of ``documents`` are dropped at the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.llm import bpe, decontaminate, line_dedup, near, toxicity
from claimscope.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on ``labels``, doesn't predict as toxic."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, carry=COLUMNS).filter("predicted = 0").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents hold stay in the last of them only; n_chars follows the text."""
    kept = line_dedup.dedup_lines(docs, carry=("lang", "source"))
    return kept.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("bigint").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (five-word shingles, likeness 0.8) one row of the smallest doc_id stays."""
    return near.one_per_class(docs, size=5, num=80, den=100).select(*COLUMNS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copied or edited passage of a test item."""
    return decontaminate.without_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the decoded text."""
    import public_tokenizers

    return bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), values=("ids",))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("bpe", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: Learned scores and edit alignment can't be expressed in SQL; the tests hold a small run against
#: a brute-force version.
ORACLE_SQL = None
