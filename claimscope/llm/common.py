"""Shared helpers: written tables, byte-bounded Arrow chunks, flat word and line hashing.

Text is handled as UTF-8 bytes in flat numpy arrays, so that one pass of vectorised
arithmetic covers many documents.  Word rules are ASCII rules (`[^\\x20\\x09-\\x0D]+`,
A-Z lower-cased), which are exact on bytes because UTF-8 continuation bytes are >= 0x80.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from claimscope.session import ensure_checkpoint_dir

CHUNK_BYTES = 1 << 20  # text bytes that one vectorised step holds; a longer document is a step of its own

_MULT = 0x9E3779B97F4A7C15  # odd: a unit modulo 2**64
_INV = pow(_MULT, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])  # word breaks of punctuation-free words
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


BATCH_ROWS = 1_000  # rows of an Arrow batch, where the session has Spark's default of 10,000


def bounded_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for tasks that hold whole texts; a session's own setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost
    executors, and gives the planner the measured size."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold at most ``limit`` text bytes each, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
        ends = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < batch.num_rows:
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(first, last - first)
            first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse, 0 .. n-1."""
    have = _POWERS.get(seed)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        mult = (_MULT + 2 * 0x632BE59BD9B4E019 * seed) % (1 << 64)
        out = []
        for m in (mult, pow(mult, -1, 1 << 64)):
            p = np.full(size, m, dtype=np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        have = (out[0], out[1])
        if size <= 4 * CHUNK_BYTES:
            _POWERS[seed] = have
    return have


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each byte span: equal bytes give equal hashes wherever they lie."""
    up, down = _powers(len(data) + 1, seed)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    value = total[1:]
    value[:] = data
    value += np.uint64(1)
    value *= up[: len(data)]
    np.cumsum(value, out=value)
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h ^ mix((ends - starts).astype(np.uint64) + np.uint64(seed + 1)))


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each document + total) of all words of a chunk; ``breaks``
    marks the byte values between words."""
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = ~breaks[data]
    begins = inside[1:-1] & ~inside[:-2]
    stops = inside[1:-1] & ~inside[2:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]  # a word never crosses from one document into the next
    begins[edge] |= inside[1:-1][edge]
    stops[edge - 1] |= inside[1:-1][edge - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each document's ``size``-word shingles; a document with
    fewer words has its whole sequence as its one shingle, one without words has none."""
    out = []
    if len(words) >= size:
        rolled = words[: len(words) - size + 1].copy()
        for k in range(1, size):
            rolled = mix(rolled * np.uint64(_MULT) + words[k : len(words) - size + 1 + k])
    for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if last - first >= size:
            out.append(np.unique(rolled[first : last - size + 1]))
        elif last > first:
            h = words[first : first + 1].copy()
            for k in range(first + 1, last):
                h = mix(h * np.uint64(_MULT) + words[k : k + 1])
            out.append(mix(h + np.uint64(last - first)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def document_shingles(column, size: int) -> list[np.ndarray]:
    data, offsets = flat(column)
    data = lowered(data)
    starts, ends, bounds = word_spans(data, offsets)
    return shingle_hashes(span_hashes(data, starts, ends), bounds, size)
