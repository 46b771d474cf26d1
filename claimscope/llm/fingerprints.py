"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the k smallest distinct 64-bit hashes of a document's five-word shingles.  Sketches
of parts merge into the sketch of the whole (the k smallest of their union), and two sketches
estimate resemblance, containment and the number of distinct shingles.  As a string a sketch is
the base64 text of its hashes, smallest first, each eight bytes big-endian; the empty text has
the empty string.

Edge cases: null text reads as empty; fewer words than a shingle make one shingle of the whole
sequence; equal shingle sets have equal sketches; two empty sketches have likeness 1, an empty
and another 0.  Rows are compared with their successor in descending id (nulls last, ties by
a hash of the text), the last with the first; many rows of one id or without one lie in many ranges
(only whole copies of a row share one); a single row is its own successor; an empty table gives none.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from claimscope.llm.common import CHUNK_BYTES, chunks, document_shingles, table

K = 256
SHINGLE = 5
SPACE = float(1 << 64)
LEAST = -(1 << 63)  # stands for a null id
RANGE_BYTES = 16 << 20  # text bytes of a range of documents, about


def sketch_texts(texts: list[str], k: int = K, size: int = SHINGLE) -> list[np.ndarray]:
    return [h[:k] for h in document_shingles(pa.array(texts, pa.large_string()), size)]


def to_string(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").tobytes()).decode()


def from_string(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), dtype=">u8").astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard likeness: the share of the union's k smallest that both hold."""
    if not len(a) and not len(b):
        return 1.0
    union = merge(a, b, k)
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).sum()) / len(union)


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact while the sketch isn't full."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1.0) / SPACE)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b holds."""
    if not len(a):
        return 1.0
    shared = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return min(1.0, shared / distinct_count(a, k))


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, size: int = SHINGLE) -> DataFrame:
    """Per row: the id, fingerprint, shingles (estimated distinct count)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            found = [h[:k] for h in document_shingles(part.column(1), size)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(map(to_string, found), pa.string()), pa.array([distinct_count(s, k) for s in found], pa.float64())],
                [id_col, "fingerprint", "shingles"],
            )

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, fingerprint string, shingles double")


def merged(sketches: DataFrame, key: str, fingerprint: str = "fingerprint", k: int = K) -> DataFrame:
    """One sketch per key, of all its parts: the k smallest distinct hashes.  Each task keeps k per key
    before the shuffle, so a key with a third of all rows sends k hashes per task."""
    raw = F.unbase64(F.col(fingerprint))
    at = F.explode(F.sequence(F.lit(0), (F.length(raw) / 8).cast("int") - 1))
    parts = sketches.filter(F.length(fingerprint) > 0).select(F.col(key), raw.alias("raw"), at.alias("at"))
    hashes = parts.select(key, F.hex(F.substring("raw", (F.col("at") * 8 + 1).cast("int"), F.lit(8))).alias("h")).distinct()
    nth = F.row_number().over(Window.partitionBy(key).orderBy("h"))
    least = hashes.withColumn("nth", nth).filter(F.col("nth") <= k)
    full = least.groupBy(key).agg(F.concat_ws("", F.array_sort(F.collect_list("h"))).alias("h"))
    out = sketches.select(key).distinct().join(full, key, "left")
    return out.select(key, F.coalesce(F.regexp_replace(F.base64(F.unhex("h")), r"\s", ""), F.lit("")).alias("fingerprint"))


def ranges(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> int:
    """Number of ranges that the text bytes ask for, at least the session's partitions."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), size // range_bytes + 1)


def with_successor(docs: DataFrame, id_col: str, text_col: str, parts: int | None = None) -> DataFrame:
    """The rows dealt by ranges of descending (id, hash of the text), sorted, each range followed by a copy
    of the first row of the next one (``extra``): a task then meets each row's successor without a global
    window.  An id that many rows share (or null) is cut between its texts.  Columns: part, sort_id, text,
    extra and the id as ``own_id``.  One shuffle of the texts, a range to a task; what the driver sees is
    one cut and one first row's key per range."""
    spark = docs.sparkSession
    base = docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(LEAST)).alias("sort_id"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("own_id")
    )
    base = base.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("tie", F.xxhash64("text"))
    parts = parts or ranges(base)
    shares = [(k + 1) / parts for k in range(parts - 1)]
    cuts = base.agg(F.percentile_approx("sort_id", shares or [0.5], max(10_000, 4 * parts))).first()[0] or []
    ranged = base.withColumn("part", _range_of(cuts if parts > 1 else [])("sort_id", "tie"))
    heads = {r["part"]: (r["head"]["sort_id"], r["head"]["tie"]) for r in ranged.groupBy("part").agg(F.max(F.struct("sort_id", "tie")).alias("head")).collect()}
    order = sorted(heads)
    if not order:
        return ranged.withColumn("extra", F.lit(False))
    # the first range's head follows the last range; ranges are numbered anew, without the empty ones
    pairs = spark.createDataFrame([(p, *heads[p], (k - 1) % len(order)) for k, p in enumerate(order)], "part int, sort_id bigint, tie bigint, before int")
    copies = (
        ranged.join(F.broadcast(pairs), ["part", "sort_id", "tie"])  # one small row per range: bounded by ``parts``
        .dropDuplicates(["part"])
        .select("sort_id", "text", "own_id", "tie", F.col("before").alias("part"), F.lit(True).alias("extra"))
    )
    numbers = spark.createDataFrame([(p, k) for k, p in enumerate(order)], "part int, number int")  # as many
    own = ranged.join(F.broadcast(numbers), "part").select("sort_id", "text", "own_id", "tie", F.col("number").alias("part"), F.lit(False).alias("extra"))
    return own.unionByName(copies).repartitionById(len(order), F.col("part")).sortWithinPartitions("part", "extra", F.desc("sort_id"), F.desc("tie"))


def _range_of(cuts: list[int]):
    """Number of cuts above a row, so the largest ids come in range 0.  An id that is m cuts holds m - 1
    ranges or more: its rows are cut into m by the hash of the text, evenly."""
    ids, times = np.unique(np.array(cuts, dtype=np.int64), return_counts=True)
    from_here = np.r_[np.cumsum(times[::-1])[::-1], 0]  # cuts at this id and the larger ones

    @F.pandas_udf("int")
    def range_of(sort_id: pd.Series, tie: pd.Series) -> pd.Series:
        key = sort_id.to_numpy(np.int64)
        at = np.searchsorted(ids, key)
        above = from_here[at]
        same = np.flatnonzero(ids[np.minimum(at, len(ids) - 1)] == key) if len(ids) else at[:0]
        level = (tie.to_numpy(np.int64)[same].view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)  # follows the order of ties
        cut = (level * times[at[same]].astype(np.uint64)) >> np.uint64(32)
        above[same] -= cut.astype(np.int64) + 1
        return pd.Series(above.astype(np.int32))

    return range_of


def _compare(k: int, size: int, id_type: pa.DataType):
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        """Runs of rows of one part, of bounded bytes; each but the last ends with its successor."""
        held: list[tuple] = []
        size_held = 0
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("part", "own_id", "text", "extra")], strict=True):
                if held and row[0] != held[-1][0]:
                    if len(held) > 1:
                        yield held
                    held, size_held = [], 0
                held.append(row)
                size_held += len(row[2])
                if size_held >= CHUNK_BYTES and len(held) > 1:
                    yield held
                    held, size_held = [row], len(row[2])
        if len(held) > 1:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in groups(batches):
            texts = [r[2] for r in held]
            edited = []
            for own, nxt in zip(texts[:-1], texts[1:], strict=True):
                cut = len(own) // 3
                edited.append(own[: len(own) - cut] + nxt[:cut])
            sketches = sketch_texts(texts, k, size)
            changed = sketch_texts(edited, k, size)
            n = len(edited)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[1] for r in held[:-1]], id_type),
                    pa.array([len(t) for t in texts[:-1]], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                    pa.array(map(to_string, sketches[:-1]), pa.string()),
                    pa.array(map(to_string, changed), pa.string()),
                    pa.array([resemblance(sketches[i], changed[i], k) for i in range(n)], pa.float64()),
                    pa.array([resemblance(sketches[i], sketches[i + 1], k) for i in range(n)], pa.float64()),
                ],
                names,
            )

    return run


def compare_with_successor(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, size: int = SHINGLE) -> DataFrame:
    """Per row: its sketch, the sketch of its edited text (the last third replaced by the beginning of
    the successor's text), and the likeness of its sketch to that one and to the successor's."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    rows = with_successor(docs, id_col, text_col)
    return rows.select("part", "own_id", "text", "extra").mapInArrow(_compare(k, size, to_arrow_type(docs.schema[id_col].dataType)), schema).withColumnRenamed("doc_id", id_col)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_successor(table(spark, sf_dir, "documents"))
