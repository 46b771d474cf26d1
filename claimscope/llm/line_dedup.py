"""Line deduplication over a sharded minimal perfect hash.

1. One pass hashes every long enough line (128 bits) and counts, per chunk, the documents that
   hold it; a grouped sum gives each distinct line's document count and largest document id.
2. The hashes of lines found in ``min_docs`` documents or more are dealt into shards by their
   leading bits.  Each shard becomes a minimal perfect hash (levels of bit arrays, ranked) that
   indexes a fingerprint, a count and a last-holder array.
3. Documents send only their line hashes to the shard arrays and get back the few that hit.  A
   line absent from the index also gets a slot; its fingerprint (the other 64 bits) tells.
4. Blocks of documents meet their hits and drop the lines.

Skew: a line that a third of all documents hold is pre-counted per chunk and its probes are
spread over ``SALTS`` copies of its shard.  Blocks are dealt by id and text, so the texts of a
repeated or null id lie in many blocks (only whole copies of a row share one).  No array goes
through the driver.

Edge cases: null and empty text are one empty line; a document may lose every line (its kept
text is then empty); a line counts once per row, so repeated rows count as documents of their
own, and all rows with the largest doc_id keep the line; a null doc_id sorts before all others;
an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.llm.common import chunks, flat, lowered, mix, span_hashes, table, written

SALTS = 16  # copies of each shard that probes are spread over
SHARD_KEYS = 16_384  # keys that a shard holds at most, about
SHARD_PROBES = 1_000_000  # line hashes that one shard's copies answer at most, about
BLOCK_BYTES = 4 << 20  # text bytes of a block of documents, about
LEAST = -(1 << 63)  # stands for a null document id
_BLANKS = np.array([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D], dtype=np.uint8)


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first line of each document + total); a document has one line at least."""
    breaks = np.flatnonzero(data == 10)
    owner = np.searchsorted(offsets, breaks, side="right") - 1
    per_doc = np.bincount(owner, minlength=len(offsets) - 1) + 1 if len(offsets) > 1 else np.zeros(0, np.int64)
    bounds = np.r_[0, np.cumsum(per_doc)]
    starts = np.empty(bounds[-1], dtype=np.int64)
    ends = np.empty(bounds[-1], dtype=np.int64)
    firsts = np.zeros(bounds[-1], dtype=bool)
    firsts[bounds[:-1]] = True
    starts[firsts] = offsets[:-1]
    starts[~firsts] = breaks + 1
    lasts = np.zeros(bounds[-1], dtype=bool)
    lasts[bounds[1:] - 1] = True
    ends[lasts] = offsets[1:]
    ends[~lasts] = breaks
    return starts, ends, bounds


def line_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines whose key is long enough, and the two 64-bit halves of the key's hash)."""
    solid = np.flatnonzero(~np.isin(data, _BLANKS))
    first = np.searchsorted(solid, starts)
    last = np.searchsorted(solid, ends)
    some = np.flatnonzero(last > first)
    begin, end = solid[first[some]], solid[last[some] - 1] + 1
    points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    long = points[end] - points[begin] >= min_chars
    some, begin, end = some[long], begin[long], end[long]
    low = lowered(data)
    return some, span_hashes(low, begin, end, 0), span_hashes(low, begin, end, 1)


class PerfectHash:
    """Levels of bit arrays: a key's slot is the rank of the first bit that is its alone."""

    LEVELS = 48

    def __init__(self, sizes: list[int], bits: bytes):
        self.sizes = sizes
        self.bits = np.frombuffer(bits, dtype=np.uint8)
        ones = np.bitwise_count(self.bits).astype(np.int64)
        self.before = np.r_[0, np.cumsum(ones)]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """``keys`` are distinct."""
        sizes, parts, level = [], [], 0
        while len(keys):
            if level >= cls.LEVELS:
                raise ValueError("keys of a perfect hash must be distinct")
            size = -(-max(8, 2 * len(keys)) // 8) * 8
            at = cls._at(keys, level, size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            parts.append(np.packbits(alone, bitorder="little"))
            keys = keys[~alone[at]]
            level += 1
        return cls(sizes, b"".join(p.tobytes() for p in parts))

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys ^ mix(np.array([level + 1], dtype=np.uint64))) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 where no level has a bit (never for a key of the set)."""
        out = np.full(len(keys), -1, dtype=np.int64)
        open_, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            at = self._at(keys[open_], level, size)
            byte, bit = base + (at >> 3), (at & 7).astype(np.uint8)
            hit = (self.bits[byte] >> bit) & 1 == 1
            under = self.bits[byte[hit]] & ((np.uint8(1) << bit[hit]) - np.uint8(1))
            out[open_[hit]] = self.before[byte[hit]] + np.bitwise_count(under)
            open_ = open_[~hit]
            base += size >> 3
        return out


def _line_rows(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            data, offsets = flat(part.column(2))
            starts, ends, bounds = line_spans(data, offsets)
            lines, h1, h2 = line_keys(data, starts, ends, min_chars)
            if not len(lines):
                continue
            row = np.searchsorted(bounds, lines, side="right") - 1
            ids = part.column(0).to_numpy(zero_copy_only=False)[row]
            block = part.column(1).to_numpy(zero_copy_only=False)[row]
            order = np.lexsort((row, block, h2, h1))
            h1, h2, row, ids, block = h1[order], h2[order], row[order], ids[order], block[order]
            same = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1]) & (block[1:] == block[:-1])
            new_key = np.r_[True, ~same]
            new_doc = np.r_[True, ~(same & (row[1:] == row[:-1]))]
            at = np.flatnonzero(new_key)
            docs = np.add.reduceat(new_doc.astype(np.int64), at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(block[at]), pa.array(h1[at].view(np.int64)), pa.array(h2[at].view(np.int64)), pa.array(docs), pa.array(np.maximum.reduceat(ids, at))],
                ["block", "h1", "h2", "docs", "last"],
            )

    return run


def _build_shard(rows: pa.Table) -> pa.Table:
    shard = rows.column("shard")[0].as_py()
    h1 = rows.column("h1").to_numpy().view(np.uint64)
    h2 = rows.column("h2").to_numpy().view(np.uint64)
    # two keys may share the first half; the index is over a mix of both halves
    ph = PerfectHash.build(mix(h1 ^ mix(h2)))
    slots = ph.slots(mix(h1 ^ mix(h2)))
    arrays = []
    for x in (h2, rows.column("docs").to_numpy(), rows.column("last").to_numpy()):
        a = np.empty(len(x), dtype=x.dtype)
        a[slots] = x
        arrays.append(a.tobytes())
    return pa.table(
        {"shard": pa.array([shard], pa.int64()), "sizes": pa.array([ph.sizes], pa.list_(pa.int64())), "bits": pa.array([ph.bits.tobytes()], pa.binary())}
        | {k: pa.array([a], pa.binary()) for k, a in zip(("fingerprints", "counts", "lasts"), arrays, strict=True)}
    )


def _probe(probes: pa.Table, index: pa.Table) -> pa.Table:
    names = ["block", "h1", "h2", "last"]
    if not index.num_rows or not probes.num_rows:
        return pa.table({n: pa.array([], pa.int64()) for n in names})
    ph = PerfectHash(index.column("sizes")[0].as_py(), index.column("bits")[0].as_py())
    fingerprints = np.frombuffer(index.column("fingerprints")[0].as_py(), dtype=np.uint64)
    lasts = np.frombuffer(index.column("lasts")[0].as_py(), dtype=np.int64)
    h1 = probes.column("h1").to_numpy().view(np.uint64)
    h2 = probes.column("h2").to_numpy().view(np.uint64)
    slot = ph.slots(mix(h1 ^ mix(h2)))
    hit = (slot >= 0) & (fingerprints[np.maximum(slot, 0)] == h2)
    out = [probes.column("block").to_numpy()[hit], h1[hit].view(np.int64), h2[hit].view(np.int64), lasts[slot[hit]]]
    return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(names, out, strict=True)})


def _drop(min_chars: int, carry: list[str]):
    def run(docs: pa.Table, hits: pa.Table) -> pa.Table:
        last_of = dict(zip(zip(hits.column("h1").to_pylist(), hits.column("h2").to_pylist(), strict=True), hits.column("last").to_pylist(), strict=True))
        known = np.unique(hits.column("h1").to_numpy().view(np.uint64))
        out = []
        for part in chunks(iter(docs.combine_chunks().to_batches()), "text"):
            text = part.column("text")
            data, offsets = flat(text)
            starts, ends, bounds = line_spans(data, offsets)
            lines, h1, h2 = line_keys(data, starts, ends, min_chars)
            maybe = np.isin(h1, known)
            lines, h1, h2 = lines[maybe], h1[maybe].view(np.int64).tolist(), h2[maybe].view(np.int64).tolist()
            row = np.searchsorted(bounds, lines, side="right") - 1
            ids = part.column("sort_id").to_numpy(zero_copy_only=False)[row].tolist()
            gone = np.zeros(len(starts), dtype=bool)
            for line, key, own in zip(lines.tolist(), zip(h1, h2, strict=True), ids, strict=True):
                gone[line] = last_of.get(key, own) != own
            dropped = np.add.reduceat(gone.astype(np.int64), bounds[:-1])
            kept = [t or "" for t in text.to_pylist()]
            raw = data.tobytes()
            for d in np.flatnonzero(dropped).tolist():
                keep = np.flatnonzero(~gone[bounds[d] : bounds[d + 1]]) + bounds[d]
                kept[d] = b"\n".join([raw[a:b] for a, b in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)]).decode()
            cols = {n: part.column(n) for n in carry}
            cols |= {"kept": pa.array(kept, pa.string()), "n_lines": pa.array(np.diff(bounds), pa.int64()), "n_dropped": pa.array(dropped, pa.int64())}
            out.append(pa.table(cols))
        return pa.concat_tables(out)

    return run


def block_of(id_: Column, text: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(id_, text), F.lit(blocks))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Per row: the id, the ``carry`` columns, kept (text), n_lines (before), n_dropped.

    A line's key is the line stripped of ASCII blanks with A-Z lower-cased.  Keys of at least
    ``min_chars`` code points in at least ``min_docs`` rows lose all their lines except in the
    row of the largest id that holds them.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    blocks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), size // BLOCK_BYTES + 1)
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(LEAST)).alias("sort_id"),
        block_of(F.col(id_col), F.col(text_col).cast("string"), blocks).alias("block"),
        F.col(text_col).cast("string").alias("text"),
        *[F.col(c).alias(f"own_{c}") for c in dict.fromkeys([id_col, *carry])],
    )
    held = written(rows.select("sort_id", "block", "text").mapInArrow(_line_rows(min_chars), "block bigint, h1 bigint, h2 bigint, docs bigint, last bigint"), "lines")
    common = written(held.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("last").alias("last")).filter(F.col("docs") >= min_docs), "repeated-lines")
    keys, probes = common.count(), held.count()
    shards = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = 1 << max(shards, keys // SHARD_KEYS, probes // (SHARD_PROBES * SALTS)).bit_length()
    shard = F.shiftrightunsigned("h1", 64 - (shards.bit_length() - 1)).alias("shard")
    index = common.select(shard, "h1", "h2", "docs", "last").groupBy("shard").applyInArrow(
        _build_shard, "shard bigint, sizes array<bigint>, bits binary, fingerprints binary, counts binary, lasts binary"
    )
    index = written(index, "line-index")
    salted = index.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    asked = held.select(shard, F.pmod("block", F.lit(SALTS)).alias("salt"), "block", "h1", "h2")
    hits = asked.groupBy("shard", "salt").cogroup(salted.groupBy("shard", "salt")).applyInArrow(_probe, "block bigint, h1 bigint, h2 bigint, last bigint")
    hits = written(hits, "line-hits").distinct()
    carried = [f"own_{c}" for c in dict.fromkeys([id_col, *carry])]
    kinds = ", ".join(f"`own_{c}` {docs.schema[c].dataType.simpleString()}" for c in dict.fromkeys([id_col, *carry]))
    out = rows.groupBy("block").cogroup(hits.groupBy("block")).applyInArrow(_drop(min_chars, carried), f"{kinds}, kept string, n_lines bigint, n_dropped bigint")
    return out.select(*[F.col(f"own_{c}").alias(c) for c in dict.fromkeys([id_col, *carry])], "kept", "n_lines", "n_dropped")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT rid, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs),
keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
often AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT rid) >= 3),
marked AS (SELECT keyed.*, often.k IS NOT NULL AND keyed.doc_id <> often.last AS gone FROM keyed LEFT JOIN often USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rid, doc_id
"""
