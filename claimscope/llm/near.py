"""N-gram Jaccard join by grouped prefixes; classes of documents that links connect.

Two documents link when ``den * |A & B| >= num * |A | B|`` for their sets of word shingles.  Any
two such sets share a shingle among the first few of each (the prefix) in one global order.

1. A pass counts prefix shingles; a filter of fixed size marks those in more than HOT documents.
   The order puts marked shingles last (any order is exact; this one keeps buckets small).
2. A second pass gives each document's size, set hash (equal sets are one node, whatever the ids), prefix and a parity bitmap.  Documents of
   one size and prefix collapse into a group (exact copies always do).
3. Groups are dealt by prefix shingle; shingles with a single group are dropped; groups of the
   others expand to their distinct sets.  A group of several sets is a bucket of its own.
4. Candidates of a bucket are verified against two pivots each; verified links make classes; then
   only candidates of different classes are compared: members outside a bucket's largest class
   with the rest.  So no pair inside a class is listed, whatever its size, and no link between
   classes is lost.  Parity bitmaps bound the symmetric difference from below and drop pairs of
   large buckets inside the join.
5. Verification intersects whole shingle sets.

Edge cases: null, empty and blank texts have no set and link with nothing; fewer words than a
shingle make one shingle of the whole sequence; repeated rows are copies; rows that share an id
though their texts differ are texts of their own; a null id has no class (component_id null); an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimscope.llm.common import chunks, document_shingles, mix, table, written
from claimscope.llm.components import components

HOT = 64  # documents whose prefixes hold a shingle, beyond which it counts as frequent
LARGE = 64  # rows of a bucket beyond which its pairs are sieved by bitmaps inside the join
FILTER_BITS = 23  # the mark filters have 2**23 bits (1 MB), whatever the input
LEAST_BITS = 1024  # bits of a parity bitmap at least; more for more than 2048 shingles
WORDS = LEAST_BITS // 64
_SALT = np.uint64(0xD1B54A32D192ED03)


class MarkFilter:
    """A set of 64-bit hashes as a bit table of fixed size: no false negatives."""

    def __init__(self, words: dict[int, int]):
        bits = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
        for k, v in words.items():
            bits[k] = v
        self.bits = bits

    @classmethod
    def of(cls, hashes: DataFrame, column: str) -> MarkFilter:
        """At most 2**17 rows reach the driver, each a part of the bit table."""
        cell = F.shiftrightunsigned(column, 64 - FILTER_BITS)
        rows = hashes.groupBy(F.shiftrightunsigned(cell, 6).alias("k")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - FILTER_BITS}) & 63 as int))")).alias("v"))
        return cls({r["k"]: r["v"] for r in rows.collect()})

    def has(self, hashes: np.ndarray) -> np.ndarray:
        cell = (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
        return (self.bits[cell >> 6] >> (cell & 63)) & 1 == 1


def prefix_size(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def _count_prefixes(size: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            found = [s[: prefix_size(len(s), num, den)] for s in document_shingles(part.column(0), size) if len(s)]
            if found:
                tokens, docs = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(docs.astype(np.int64))], ["token", "docs"])

    return run


def _digest(values: np.ndarray, n: int) -> bytes:
    sums = np.array([mix(values).sum(dtype=np.uint64), mix(values ^ _SALT).sum(dtype=np.uint64)], dtype=np.uint64)
    return mix(sums ^ np.uint64(n)).tobytes()


def parity_bitmap(shingles: np.ndarray) -> np.ndarray:
    """Each shingle flips one bit, so that two bitmaps differ in no more bits than their sets in
    shingles.  Half a bit per shingle at least: bitmaps of unlike sets then differ in more bits than
    those of linked sets may.  A longer bitmap folds into a shorter one by XOR of its parts."""
    bits = max(LEAST_BITS, 1 << max(0, (len(shingles) - 1) // 2).bit_length())
    flips = np.bincount((mix(shingles ^ _SALT) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(np.int64)


def folded(bitmap: np.ndarray, words: int) -> np.ndarray:
    return bitmap if len(bitmap) == words else np.bitwise_xor.reduce(bitmap.reshape(-1, words), axis=0)


def _near_pairs(num: int, den: int):
    """Pairs whose bitmaps leave it open whether they link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_numpy() + batch.column(4).to_numpy()
            most = sizes - 2 * -(-num * sizes // (num + den))
            keep = np.zeros(batch.num_rows, dtype=bool)
            for k, (x, y) in enumerate(zip(batch.column(3), batch.column(5), strict=True)):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                words = min(len(x), len(y))
                keep[k] = int(np.bitwise_count((folded(x, words) ^ folded(y, words)).view(np.uint64)).sum()) <= most[k]
            yield batch.select([0, 1]).filter(pa.array(keep))

    return run


def _describe(size: int, num: int, den: int, hot: MarkFilter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            n, sets, groups, prefixes, bitmaps = [], [], [], [], []
            for s in document_shingles(part.column(1), size):
                n.append(len(s))
                sets.append(_digest(s, len(s)))
                marked = hot.has(s)
                prefix = np.concatenate([s[~marked], s[marked]])[: prefix_size(len(s), num, den)] if len(s) else s
                groups.append(_digest(prefix, len(s)))
                prefixes.append(prefix.view(np.int64))
                bitmaps.append(parity_bitmap(s))
            ends = np.cumsum([0, *map(len, prefixes)])
            bit_ends = np.cumsum([0, *map(len, bitmaps)])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(n, pa.int64()),
                    pa.array(sets, pa.binary()),
                    pa.array(groups, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(prefixes))),
                    pa.ListArray.from_arrays(pa.array(bit_ends, pa.int32()), pa.array(np.concatenate(bitmaps))),
                ],
                ["doc_id", "n", "s", "g", "prefix", "bits"],
            )

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token those whose token occurs again; at most one row is held over."""
    held, open_token = None, None  # a last row that is alone so far; a token that has had two rows
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            held = None
        token = batch.column(0).to_numpy()
        new = np.r_[True, token[1:] != token[:-1]]
        begins = np.flatnonzero(new)
        sizes = np.diff(np.r_[begins, len(token)])
        keep = np.repeat(sizes > 1, sizes)
        if open_token is not None and token[0] == open_token:
            keep[: sizes[0]] = True
        if not keep[-1]:
            held = batch.slice(len(token) - 1)
            open_token = None
        else:
            open_token = token[-1]
        if keep.any():
            yield batch.filter(pa.array(keep))


def _similar_size(a: Column, b: Column, num: int, den: int) -> Column:
    return F.least(a, b) * den >= F.greatest(a, b) * num


def _folded_word(bits: str, k: int) -> Column:
    """Word k of the bitmap folded to the least length."""
    parts = F.filter(bits, lambda _, i: i % WORDS == k)
    return F.aggregate(parts, F.lit(0).cast("bigint"), lambda t, x: t.bitwiseXOR(x))


def _most_apart(a: Column, b: Column, num: int, den: int) -> Column:
    """Largest symmetric difference that two sets of these sizes may have when they link."""
    return a + b - 2 * F.ceil((a + b) * num / F.lit(float(num + den)) - 1e-9)


def _with_set(size: int, names: list[str], text: str):
    """The columns ``names`` and near_set, the set hash (null: no words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text):
            found = document_shingles(part.column(part.schema.get_field_index(text)), size)
            sets = pa.array([_digest(s, len(s)) if len(s) else None for s in found], pa.binary())
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in names), sets], [*names, "near_set"])

    return run


def _sets(size: int, wanted: MarkFilter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(wanted.has(batch.column(1).to_numpy().view(np.uint64))))
            for part in chunks(iter([batch]), "text"):
                found = document_shingles(part.column(2), size)
                ends = np.cumsum([0, *map(len, found)])
                names = pa.array([_digest(s, len(s)) for s in found], pa.binary())
                yield pa.RecordBatch.from_arrays([names, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found).view(np.int64)))], ["s", "shingles"])

    return run


class Join:
    """One run of the join over ``docs`` (doc_id, text)."""

    def __init__(self, docs: DataFrame, size: int, num: int, den: int):
        self.docs, self.size, self.num, self.den = docs, size, num, den

    def describe(self) -> None:
        texts = self.docs.select("text")
        counted = texts.mapInArrow(_count_prefixes(self.size, self.num, self.den), "token bigint, docs bigint")
        frequent = counted.groupBy("token").agg(F.sum("docs").alias("docs")).filter(F.col("docs") > HOT)
        hot = MarkFilter.of(frequent, "token")
        schema = "doc_id bigint, n bigint, s binary, g binary, prefix array<bigint>, bits array<bigint>"
        self.described = written(self.docs.select("doc_id", "text").mapInArrow(_describe(self.size, self.num, self.den, hot), schema), "described")
        some = self.described.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
        # distinct sets and groups, numbered as they are written; a set's label is its smallest document
        sets = some.groupBy("s").agg(F.min("doc_id").alias("label"), F.first("n").alias("n"), F.first("g").alias("g"), F.first("bits").alias("bits"))
        sets = written(sets.withColumn("node", F.monotonically_increasing_id()), "sets")
        groups = written(some.groupBy("g").agg(F.first("prefix").alias("prefix")).withColumn("gid", F.monotonically_increasing_id()), "groups")
        self.nodes = written(sets.join(groups.select("g", "gid"), "g").select("s", "node", "label", "gid", "n", "bits"), "nodes")
        dealt = groups.select(F.explode("prefix").alias("token"), "gid").repartition("token").sortWithinPartitions("token")
        shared = written(dealt.mapInArrow(_shared, "token bigint, gid bigint"), "shared")
        light = self.nodes.select("gid", "node", "n")
        several = light.groupBy("gid").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("gid")
        inside = light.join(written(several, "several"), "gid").select(F.lit(True).alias("inside"), F.col("gid").alias("token"), "gid", "node", "n")
        between = shared.join(light, "gid").select(F.lit(False).alias("inside"), "token", "gid", "node", "n")
        self.members = written(inside.unionByName(between), "members")

    def pairs_with_pivots(self, classes: DataFrame | None) -> DataFrame:
        """Each bucket's members with one pivot: the smallest at first, then (given classes) one drawn per
        bucket, for members of another class."""
        members = self.members if classes is None else self.classed(classes)
        order = F.col("node") if classes is None else F.xxhash64("node", "token")
        extra = [] if classes is None else ["component"]
        pivots = members.groupBy("inside", "token").agg(F.min(F.struct(order.alias("o"), "node", "gid", "n", *extra)).alias("p"))
        pivots = written(pivots, "pivots")
        met = members.join(pivots, ["inside", "token"])
        apart = F.col("node") != F.col("p.node")
        if classes is not None:
            apart &= F.col("component") != F.col("p.component")
        apart &= (F.col("inside") | (F.col("gid") != F.col("p.gid"))) & _similar_size(F.col("n"), F.col("p.n"), self.num, self.den)
        return _ordered(met.filter(apart), F.col("node"), F.col("p.node"))

    def classed(self, classes: DataFrame) -> DataFrame:
        joined = self.members.join(classes, "node", "left")
        return written(joined.select("inside", "token", "gid", "node", "n", F.coalesce("component", "node").alias("component")), "classed")

    def pairs_across(self, classes: DataFrame) -> DataFrame:
        """All candidates of different classes: members outside their bucket's largest class, with the rest."""
        members = self.classed(classes)
        per_class = members.groupBy("inside", "token", "component").agg(F.count(F.lit(1)).alias("c"))
        buckets = per_class.groupBy("inside", "token").agg(F.max(F.struct("c", "component")).alias("top"), F.sum("c").alias("total"), F.count(F.lit(1)).alias("classes"))
        buckets = written(buckets.filter("classes > 1").select("inside", "token", F.col("top.component").alias("largest"), "total"), "buckets")
        open_ = written(members.join(buckets, ["inside", "token"]), "open-buckets")
        out = None
        for large in (False, True):
            rows = open_.filter(F.col("total") > LARGE if large else F.col("total") <= LARGE)
            if large:
                bits = self.nodes.select("node", *[_folded_word("bits", k).alias(f"w{k}") for k in range(WORDS)])
                # a pair meets in every large bucket that both share: it is listed in the smallest one only
                own = written(rows.filter(~F.col("inside")).groupBy("node").agg(F.collect_set("token").alias("tokens")), "bucket-lists")
                rows = written(rows.join(bits, "node").join(own, "node", "left"), "open-large")
            columns = ("node", "gid", "n", "component", *([f"w{k}" for k in range(WORDS)] + ["tokens"] if large else []))
            outside = written(rows.filter("component <> largest"), "outside").select("inside", "token", *[F.col(c).alias(f"x_{c}") for c in columns])
            ok = (F.col("component") != F.col("x_component")) & ((F.col("component") == F.col("largest")) | (F.col("x_node") < F.col("node")))
            ok &= (F.col("r_inside") | (F.col("gid") != F.col("x_gid"))) & _similar_size(F.col("n"), F.col("x_n"), self.num, self.den)
            if large:
                differ = sum((F.bit_count(F.col(f"w{k}").bitwiseXOR(F.col(f"x_w{k}"))) for k in range(1, WORDS)), F.bit_count(F.col("w0").bitwiseXOR(F.col("x_w0"))))
                ok &= differ <= _most_apart(F.col("n"), F.col("x_n"), self.num, self.den)
                ok &= F.col("r_inside") | (F.col("r_token") == F.array_min(F.array_intersect("tokens", "x_tokens")))
            rest = rows.select(F.col("inside").alias("r_inside"), F.col("token").alias("r_token"), "largest", *columns)
            met = rest.join(outside, (F.col("inside") == F.col("r_inside")) & (F.col("token") == F.col("r_token")) & ok)
            part = _ordered(met, F.col("node"), F.col("x_node"))
            out = part if out is None else out.unionByName(part)
        return out.distinct()

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link: bitmaps first, then whole sets."""
        bits = self.nodes.select("node", "n", "bits")
        a = bits.select(F.col("node").alias("a"), F.col("n").alias("a_n"), F.col("bits").alias("a_bits"))
        b = bits.select(F.col("node").alias("b"), F.col("n").alias("b_n"), F.col("bits").alias("b_bits"))
        described = written(pairs, "pairs").join(a, "a").join(b, "b").select("a", "b", "a_n", "a_bits", "b_n", "b_bits")
        near = written(described.mapInArrow(_near_pairs(self.num, self.den), "a bigint, b bigint"), "near-pairs")
        ids = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
        ids = written(self.nodes.select("node", "s", "label").join(ids, "node"), "candidate-nodes")
        wanted = MarkFilter.of(ids.select(F.xxhash64("label").alias("h")), "h")
        texts = self.docs.filter(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("doc_id").alias("h"), "text")
        # one row of each set: copies that pass the filter would meet each other below
        sets = texts.mapInArrow(_sets(self.size, wanted), "s binary, shingles array<bigint>").dropDuplicates(["s"])
        sets = written(sets.join(ids, "s").select("node", "shingles"), "candidate-sets")
        left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("a_set"))
        right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("b_set"))
        both = near.join(left, "a").join(right, "b")
        common = F.size(F.array_intersect("a_set", "b_set"))
        union = F.size("a_set") + F.size("b_set") - common
        return written(both.filter(common * self.den >= union * self.num).select("a", "b").distinct(), "links")

    def classes(self) -> DataFrame:
        """(s, label, class) of every distinct set; label is its smallest doc_id, class a node number."""
        self.describe()
        links = self.verified(self.pairs_with_pivots(None))
        links = links.unionByName(self.verified(self.pairs_with_pivots(components(links))))
        links = links.unionByName(self.verified(self.pairs_across(components(links))))
        found = self.nodes.select("s", "node", "label").join(components(links), "node", "left")
        return written(found.select("s", "label", F.coalesce("component", "node").alias("class")), "classed-sets")

    def run(self) -> DataFrame:
        """(doc_id, n, component) of every row; component is the smallest doc_id of its class."""
        sets = self.classes()
        least = written(sets.groupBy("class").agg(F.min("label").alias("component")), "class-labels")
        named = written(sets.join(least, "class").select("s", "component"), "set-classes")
        rows = self.described.select("doc_id", "n", "s")
        return rows.join(named, "s", "left").select(
            "doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))).alias("component")
        )


def _ordered(rows: DataFrame, x: Column, y: Column) -> DataFrame:
    return rows.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).filter("a <> b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Per row: the id, n_shingles (set size), component_id (smallest id reachable by links).  Two
    documents link when den * intersection >= num * union of their ``size``-word shingle sets."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = Join(rows, size, num, den).run()
    return found.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs``, all columns, that are no near copy of a row with a smaller id: of each class
    one row, that of the smallest id (of several with this id, of the smallest set hash).  Rows
    without words or without an id all stay."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sets = Join(rows, size, num, den).classes()
    first = written(sets.groupBy("class").agg(F.min(F.struct("label", "s")).alias("f")).select(F.col("f.label").alias("near_id"), F.col("f.s").alias("near_set")), "class-firsts")
    schema = T.StructType([*docs.schema.fields, T.StructField("near_set", T.BinaryType())])
    named = docs.mapInArrow(_with_set(size, docs.columns, text_col), schema).withColumn("near_id", F.col(id_col).cast("bigint"))
    some = F.col("near_set").isNotNull() & F.col("near_id").isNotNull()
    kept = named.filter(some).join(first, ["near_id", "near_set"], "left_semi").dropDuplicates(["near_id", "near_set"])
    return kept.select(*docs.columns).unionByName(named.filter(~some).select(*docs.columns))


def op4_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=4, num=85, den=100)
