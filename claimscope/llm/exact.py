"""Exact deduplication over a cuckoo-filter index of live digests.

A text's digest is the SHA-256 of its normalised text (ASCII blanks deleted).  The index holds, in
the shared folder:

* content: one light row per document (digest, id, length), the stored keys of the filter;
* filters: one cuckoo table per shard of the digests: 16-bit fingerprints, four to a bucket, each
  in one of two buckets that fingerprint and bucket number lead to, so that it can be deleted;
* hits: digests that the filter found to be there already.

``add`` folds the new rows' digests per task, deals them by shard and streams them past the shard's
table: unknown ones are inserted, known ones are hits.  Hits are verified against the content: those
of a single document are false ones and are inserted after all.  A table that is full gets a larger
one beside it for the rest of the stream; afterwards such shards are built anew from the stored keys
in one table with room to spare.  ``remove`` deletes digests whose last document goes.

Only digests that are hits are grouped, so unique texts are never shuffled again.  A task holds the
tables of one shard (about 3 bytes a key) and, while it rebuilds, one shard's keys (8 bytes each).
Copies of one text fold to a row per task before the shuffle; joins read written tables, whose hot
digests can be split.

Edge cases: null and empty texts, and texts of blanks alone, are equal to one another; a null id is
the largest; of rows that tie in length and id one stays (by its place in the stored content); an empty table gives an
empty result; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.llm.common import bounded_batches, mix, shared_path, table, written

BLANKS = " \t\n\x0b\x0c\r"
WAYS = 4  # fingerprints of a bucket
MOVES = 200  # rounds of moving fingerprints before a table counts as full
FILL = 0.9  # share of a table's places that may be taken
FOLD_ROWS = 50_000  # rows that a task folds at a time
STEP = 4_096  # keys that are inserted at a time
SHARD_KEYS = 1 << 20  # keys of a shard, as planned
TABLE, DELETE, INSERT, FORCE = range(4)  # in the order in which a shard's rows are applied


class Cuckoo:
    """A set of 64-bit keys as a table of fingerprints: no false negatives, deletion of what is in it."""

    def __init__(self, keys: int = 0, places: np.ndarray | None = None):
        buckets = 1 << max(4, int(np.ceil(np.log2(max(1, keys) / (FILL * WAYS)))))
        self.places = np.zeros((buckets, WAYS), np.uint16) if places is None else places
        self.used = int(np.count_nonzero(self.places))

    @classmethod
    def loads(cls, data: bytes) -> Cuckoo:
        return cls(places=np.frombuffer(data, np.uint16).reshape(-1, WAYS).copy())

    def dumps(self) -> bytes:
        return self.places.tobytes()

    def _marks(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprint (never 0) and first bucket."""
        return np.maximum(keys >> np.uint64(48), np.uint64(1)).astype(np.uint16), (keys & np.uint64(len(self.places) - 1)).astype(np.int64)

    def _other(self, mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(mark) & np.uint64(len(self.places) - 1)).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        mark, one = self._marks(keys)
        return (self.places[one] == mark[:, None]).any(1) | (self.places[self._other(mark, one)] == mark[:, None]).any(1)

    def insert(self, keys: np.ndarray) -> bool:
        """Insert all keys, or none and return False: the table is full."""
        if self.used + len(keys) > FILL * self.places.size:
            return False
        before = self.places.copy()
        mark, bucket = self._marks(keys)
        for turn in range(MOVES):
            order = np.argsort(bucket, kind="stable")
            mark, bucket = mark[order], bucket[order]
            nth = np.arange(len(bucket)) - np.searchsorted(bucket, bucket)  # among those that wait at one bucket
            free = self.places[bucket] == 0
            fits = nth < free.sum(1)
            place = (np.cumsum(free, 1) > nth[:, None]).argmax(1)
            self.places[bucket[fits], place[fits]] = mark[fits]
            mark, bucket = mark[~fits], bucket[~fits]
            if not len(mark):
                self.used += len(keys)
                return True
            if turn:  # both buckets were full: one at each takes a place there, and what was in it moves on
                lead = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                at = (mix(bucket[lead] + np.int64(turn) * 0x10001) % np.uint64(WAYS)).astype(np.int64)
                out = self.places[bucket[lead], at]
                self.places[bucket[lead], at] = mark[lead]
                mark[lead] = out
            bucket = self._other(mark, bucket)
        self.places = before
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Delete keys that are in the set, one fingerprint each."""
        mark, one = self._marks(keys)
        for m, a, b in zip(mark, one.tolist(), self._other(mark, one).tolist(), strict=True):
            for bucket in (a, b):
                at = np.flatnonzero(self.places[bucket] == m)
                if len(at):
                    self.places[bucket, at[0]] = 0
                    self.used -= 1
                    break


def key_of(digests: pa.Array) -> np.ndarray:
    """The filter's 64-bit keys: the digests' second eight bytes (the first deal out the shards)."""
    width = 32
    flat = pa.array(digests, pa.binary()).cast(pa.binary(width))
    data = np.frombuffer(flat.buffers()[1], np.uint8)[flat.offset * width : (flat.offset + len(flat)) * width]
    return data.reshape(-1, width)[:, 8:16].copy().view(np.uint64).ravel()


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct digests with their number of rows, FOLD_ROWS rows at a time."""
    held: list[pa.RecordBatch] = []

    def fold() -> Iterator[pa.RecordBatch]:
        if held:
            counted = pa.Table.from_batches(held).group_by("digest").aggregate([([], "count_all")])
            yield from counted.rename_columns(["digest", "n"]).to_batches()
            held.clear()

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= FOLD_ROWS:
            yield from fold()
    yield from fold()


_OUT = ["shard", "digest", "places", "nth"]


class _Shard:
    """One shard while its rows stream by."""

    def __init__(self, number: int, expected: int):
        self.number, self.expected, self.tables = number, expected, []

    def add(self, keys: np.ndarray) -> None:
        for i in range(0, len(keys), STEP):
            part = keys[i : i + STEP]
            while not (self.tables and self.tables[-1].insert(part)):
                largest = self.tables[-1].places.size if self.tables else 0
                self.tables.append(Cuckoo(max(2 * largest, self.expected, 2 * len(part))))

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.zeros(len(keys), dtype=bool)
        for t in self.tables:
            found |= t.has(keys)
        return found

    def take(self, kind: int, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if kind == TABLE:
            self.tables = [Cuckoo.loads(x) for x in rows.column("places").to_pylist()]
            return
        for i in range(0, rows.num_rows, STEP):
            part = rows.slice(i, STEP)
            keys = key_of(part.column("digest"))
            if kind == DELETE:
                self.tables[0].delete(keys)
            elif kind == FORCE:
                self.add(keys)
            else:
                # copies within this step meet here, all others meet in the filter
                distinct, first, copies = np.unique(keys, return_index=True, return_counts=True)
                known = self.has(distinct)
                self.add(distinct[~known])
                again = (part.column("n").to_numpy() > 1) | np.isin(keys, distinct[known | (copies > 1)])
                if again.any():
                    hits = part.column("digest").filter(pa.array(again))
                    yield self._rows(hits, [None] * len(hits), [None] * len(hits))

    def tables_out(self) -> Iterator[pa.RecordBatch]:
        for k, t in enumerate(self.tables):
            yield self._rows([None], [t.dumps()], [k])

    def _rows(self, digests, places, nth) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(([self.number] * len(digests), digests, places, nth), kinds, strict=True)], _OUT)


def _stream(expected: int):
    """Rows sorted by (shard, kind): hits, and the shards' tables after them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: _Shard | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            shard, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])])
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(shard)], strict=True):
                if open_ is None or open_.number != shard[a]:
                    if open_ is not None:
                        yield from open_.tables_out()
                    open_ = _Shard(int(shard[a]), expected)
                yield from open_.take(int(kind[a]), batch.slice(a, b - a))
        if open_ is not None:
            yield from open_.tables_out()

    return run


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One table for each shard from all its keys, with room for as many more."""
    open_, keys = None, []

    def build() -> Iterator[pa.RecordBatch]:
        own = np.concatenate(keys)
        shard, size = _Shard(open_, 0), 2 * len(own)
        while True:
            t = Cuckoo(size)
            if all(t.insert(own[i : i + STEP]) for i in range(0, len(own), STEP)):
                break
            size *= 2
        shard.tables = [t]
        yield from shard.tables_out()

    for batch in batches:
        shard = batch.column("shard").to_numpy()
        cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else np.zeros(0, np.int64)
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(shard)], strict=True):
            if open_ is not None and open_ != shard[a]:
                yield from build()
                keys.clear()
            open_ = int(shard[a])
            keys.append(key_of(batch.column("digest").slice(a, b - a)))
    if open_ is not None:
        yield from build()


class LiveIndex:
    """The live documents' digests below ``path``, in ``shards`` parts; ``expected`` keys per shard at first."""

    CONTENT = "digest binary, doc_id bigint, n_chars bigint, row string"
    FILTERS = "shard bigint, digest binary, places binary, nth int"

    def __init__(self, spark: SparkSession, path: str, shards: int, expected: int = SHARD_KEYS):
        self.spark, self.path, self.shards, self.expected = spark, path, shards, expected
        self.version = 0
        for name, schema in (("content/batch=0", self.CONTENT), ("removed/batch=0", "row string"), ("hits/batch=0", "digest binary"), ("filters/v0", self.FILTERS)):
            spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/{name}")

    def _read(self, name: str, schema: str) -> DataFrame:
        names = [field.split()[0] for field in schema.split(", ")]
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").select(*names)  # without the batch

    def content(self) -> DataFrame:
        """The stored rows of live documents."""
        return self._read("content", self.CONTENT).join(self._read("removed", "row string"), "row", "left_anti")

    def filters(self) -> DataFrame:
        return self._read(f"filters/v{self.version}", self.FILTERS).filter("places IS NOT NULL").select("shard", "places", "nth")

    def _shard(self):
        return F.pmod(F.xxhash64("digest"), F.lit(self.shards)).alias("shard")

    def _apply(self, changes: DataFrame) -> DataFrame:
        """Stream (kind, digest, n) past the filters: a new version of them; the digests that are hits."""
        bounded_batches(self.spark)
        blank = F.lit(None).cast("binary")
        tables = self.filters().select("shard", F.lit(TABLE).alias("kind"), blank.alias("digest"), F.lit(0).cast("bigint").alias("n"), "places")
        rows = changes.select(self._shard(), "kind", "digest", "n", blank.alias("places")).unionByName(tables)
        dealt = rows.repartition(self.shards, "shard").sortWithinPartitions("shard", "kind")
        path = f"{self.path}/filters/v{self.version + 1}"
        dealt.mapInArrow(_stream(self.expected), self.FILTERS).write.parquet(path)
        self.version += 1
        hits = self._read(f"filters/v{self.version}", self.FILTERS).filter("digest IS NOT NULL").select("digest")
        self._resize()
        return hits

    def _resize(self) -> None:
        """Shards whose keys outgrew their table get one new table, from the stored keys."""
        full = written(self.filters().filter("nth > 0").select("shard").distinct(), "full-shards")
        if full.isEmpty():
            return
        keys = self.content().select(self._shard(), "digest").join(full, "shard", "left_semi").distinct()
        new = keys.repartition(self.shards, "shard").sortWithinPartitions("shard").mapInArrow(_rebuilt, self.FILTERS)
        rest = self._read(f"filters/v{self.version}", self.FILTERS).filter("places IS NOT NULL").join(full, "shard", "left_anti")
        new.unionByName(rest.select("shard", "digest", "places", "nth")).write.parquet(f"{self.path}/filters/v{self.version + 1}")
        self.version += 1

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        batch = self.version + 1
        rows = docs.select(
            F.unhex(F.sha2(F.translate(text, BLANKS, ""), 256)).alias("digest"),
            F.col(id_col).cast("bigint").alias("doc_id"),
            F.length(text).cast("bigint").alias("n_chars"),
            F.concat_ws("-", F.lit(batch), F.monotonically_increasing_id()).alias("row"),
        )
        rows.write.parquet(f"{self.path}/content/batch={batch}")
        new = self._read(f"content/batch={batch}", self.CONTENT).select("digest")
        folded = new.mapInArrow(_folded, "digest binary, n bigint").select(F.lit(INSERT).alias("kind"), "digest", "n")
        hits = written(self._apply(folded).distinct(), "filter-hits")
        # verified against the content: a hit of one live row alone was false, and isn't in the filter yet
        found = self.content().join(hits, "digest", "left_semi").groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
        found = written(found, "verified-hits")
        found.filter("n > 1").select("digest").write.parquet(f"{self.path}/hits/batch={batch}")
        false = found.filter("n = 1").select(F.lit(FORCE).alias("kind"), "digest", "n")
        if not false.isEmpty():
            self._apply(false)

    def remove(self, ids: DataFrame, id_col: str = "doc_id") -> None:
        """Documents with these ids are no longer live; digests that none holds any more leave the filter."""
        batch = self.version + 1
        gone = written(self.content().join(ids.select(F.col(id_col).cast("bigint").alias("doc_id")).distinct(), "doc_id", "left_semi"), "gone")
        gone.select("row").write.parquet(f"{self.path}/removed/batch={batch}")
        dead = gone.select("digest").distinct().join(self.content().select("digest"), "digest", "left_anti")
        self._apply(written(dead, "dead-digests").select(F.lit(DELETE).alias("kind"), "digest", F.lit(1).cast("bigint").alias("n")))

    def maybe(self, digests: DataFrame) -> DataFrame:
        """Of the digests those that the filter knows: all live ones, and few others."""
        self._check_one_table()
        asked = digests.select("digest").distinct().select(self._shard(), "digest")
        tables = self.filters().select("shard", "places")

        def probe(asked: pa.Table, tables: pa.Table) -> pa.Table:
            if not asked.num_rows or not tables.num_rows:
                return asked.slice(0, 0).select(["digest"])
            known = Cuckoo.loads(tables.column("places")[0].as_py()).has(key_of(asked.column("digest").combine_chunks()))
            return asked.select(["digest"]).filter(pa.array(known))

        return asked.groupBy("shard").cogroup(tables.groupBy("shard")).applyInArrow(probe, "digest binary")

    def _check_one_table(self) -> None:
        if not self.filters().filter("nth > 0").isEmpty():
            raise RuntimeError("a shard has more than one table: an update was broken off")

    def groups(self) -> DataFrame:
        """Per live document: doc_id, keep_id, group_size, kept, digest."""
        live = self.content()
        hits = written(self._read("hits", "digest binary").distinct(), "known-hits")
        best = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
        found = live.join(hits, "digest", "left_semi").groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best"))
        found = written(found.select("digest", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("best_row")), "groups")
        return live.join(found, "digest", "left").select(
            "doc_id",
            F.when(F.col("best_row").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
            F.coalesce(F.col("row") == F.col("best_row"), F.lit(True)).alias("kept"),
            "digest",
        )


def index_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_keys: int = SHARD_KEYS) -> LiveIndex:
    """A new index of ``docs`` in the shared folder, its shards sized by the number of rows."""
    spark = docs.sparkSession
    rows = docs.count()
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // shard_keys + 1)
    index = LiveIndex(spark, shared_path(spark, "live"), shards, expected=max(64, 2 * rows // shards))
    index.add(docs, id_col, text_col)
    return index


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = index_of(table(spark, sf_dir, "documents")).groups()
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = r"""
WITH docs AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, text_sha256,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) = 1 AS kept
FROM docs
"""
