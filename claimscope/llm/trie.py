"""Conversation prefix trie: every distinct sequence of first turns is a node over its members.

1. Turns get their places by one range sort of all turns; the few conversations that lie across
   partitions carry their counts over, so a conversation may hold any share of all rows.
2. Each conversation is rebuilt: the first turns of its family's head, then its own later ones.
3. A turn that no other conversation has at its place ends what a conversation can share.  What
   follows it (the private tail) needs no sorting: its nodes have one member and one child each.
4. The conversations, cut there, are sorted by their turns' digests, and dealt by range.  Each block
   of the sorted order gets the common prefix lengths (LCP) of neighbours and sparse tables of their
   range minima.  Each candidate prefix searches its left and right extent by halving steps through
   the tables, independently of all others; the one at its own left extent is the node.
   Over the rows (l, r] of a node of depth d with LCPs: those equal to d begin its further children;
   those below the length of the row before end its further leaves; the bytes of the shared prefixes,
   less those of depth d - 1, are what its subtree saves.
5. A node that touches a block's border is one of the few open ones: its parts from all blocks are
   added up by the prefix's hash (128 bits) and depth.

A conversation is one row in step 4, 16 bytes a turn that it shares; everything else is a row per
turn.  The ids that end at one node are hashed in order as a stream: SHA-256 of one list is sequential,
so copies of one conversation, however many, pass through one task as joined pieces, in fixed memory.

Edge cases: null roles and texts are empty; rows without a conversation id are no conversation's;
turns of equal number (nulls first) go by the SHA-256 of their role and text, repeated rows are turns
of their own; conversations may be without turns (members of the root); an empty table has no node;
only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimscope.llm.common import mix, table, written

FAMILY = 5  # conversations c - c % FAMILY and the next ones share their head
HEADS = 9  # a conversation takes fewer than HEADS turns of its family's head
TURNS = 1 << 20  # turns of a partition, as planned
CANDIDATES = 1 << 17  # candidate prefixes of a block, unless one conversation has more
EMPTY = hashlib.sha256(b"").hexdigest()
_LANES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03))


# --- places of turns ---------------------------------------------------------------------------


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place of each turn among its conversation's turns in this partition, whose number is added."""
    part, open_, count = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        conv = batch.column("conv_id").to_numpy()
        if not len(conv):
            continue
        begins = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
        place = np.arange(len(conv)) - np.repeat(begins, np.diff(np.r_[begins, len(conv)]))
        if conv[0] == open_:
            place[: begins[1] if len(begins) > 1 else len(conv)] += count
        open_, count = conv[-1], int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), pa.array(np.full(len(conv), part, np.int32)), pa.array(place), batch.column("id"), batch.column("size")], ["conv_id", "part", "place", "id", "size"]
        )


def placed(turns: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, id, size) of every turn; (conv_id, len) of every conversation."""
    keys = ["conv_id", "turn", "id", "tie"]  # the tie lets equal rows be dealt apart
    dealt = turns.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    rows = written(dealt.mapInArrow(_runs, "conv_id bigint, part int, place bigint, id binary, size bigint"), "turn-runs")
    runs = written(rows.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n")), "run-lengths")
    several = written(runs.groupBy("conv_id").agg(F.count(F.lit(1)).alias("runs")).filter("runs > 1").select("conv_id"), "split-conversations")
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition at most
    before = written(runs.join(several, "conv_id", "left_semi").select("conv_id", "part", F.sum("n").over(earlier).alias("before")), "carried")
    turns = rows.join(before, ["conv_id", "part"], "left").select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("pos"), "id", "size")
    return turns, runs.groupBy("conv_id").agg(F.sum("n").alias("len"))


def rebuilt(turns: DataFrame, lens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, total, pos, id, size) of the rebuilt turns; (conv_id, total) of every conversation."""
    lens = written(lens, "lengths")
    convs = lens.select("conv_id", "len", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    known = convs.join(lens.select(F.col("conv_id").alias("base"), F.col("len").alias("base_len")), "base", "left")
    m = F.least("h", F.coalesce("base_len", F.lit(0))).alias("m")
    convs = written(known.select("conv_id", "base", "h", m, (m + F.greatest(F.col("len") - F.col("h"), F.lit(0))).alias("total")), "conversations")
    turns = written(turns, "turns")
    heads = turns.filter(F.col("pos") < HEADS - 1).withColumnRenamed("conv_id", "base").join(convs, "base").filter("pos < m").select("conv_id", "total", "pos", "id", "size")
    tails = turns.join(convs, "conv_id").filter("pos >= h").select("conv_id", "total", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "id", "size")
    return written(heads.unionByName(tails), "rebuilt"), convs.select("conv_id", "total")


# --- blocks of sorted conversations --------------------------------------------------------------


def least_tables(values: np.ndarray) -> list[np.ndarray]:
    """Sparse table: entry x of level j is the least of values[x : x + 2**j]."""
    out = [values]
    while len(out[-1]) > (half := 1 << (len(out) - 1)):
        out.append(np.minimum(out[-1][:-half], out[-1][half:]))
    return out


def extents(tables: list[np.ndarray], row: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Furthest rows left and right of each row whose LCPs on the way are all at least the depth."""
    last = len(tables[0]) - 1
    left, right = row.copy(), row.copy()
    for level in reversed(range(len(tables))):
        step, least = 1 << level, tables[level]
        to = left - step
        ok = (to >= 0) & (least[np.clip(to + 1, 0, len(least) - 1)] >= depth)
        left = np.where(ok, to, left)
        ok = (right + step <= last) & (least[np.clip(right + 1, 0, len(least) - 1)] >= depth)
        right = np.where(ok, right + step, right)
    return left, right


def common_prefix(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    apart = np.flatnonzero((a[:n] != b[:n]).any(axis=1))
    return int(apart[0]) if len(apart) else n


def _ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and place of each of ``lengths`` items."""
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    return owner, np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


class _Block:
    """Sorted conversations: ids as two 64-bit words a turn, in flat arrays."""

    def __init__(self, batch: pa.RecordBatch):
        ids, sizes = batch.column("ids"), batch.column("sizes")
        self.conv = batch.column("conv_id").to_numpy()
        self.total = batch.column("total").to_numpy()
        self.len = np.diff(ids.offsets.to_numpy()).astype(np.int64)
        self.start = np.r_[0, np.cumsum(self.len)]
        flat = ids.flatten().cast(pa.binary(16))
        data = flat.buffers()[1]
        words = np.frombuffer(data, np.uint64) if data is not None and len(flat) else np.zeros(0, np.uint64)
        self.ids = words.reshape(-1, 2)[flat.offset : flat.offset + len(flat)]
        self.sizes = sizes.flatten().to_numpy()

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray, int]:
        own = slice(self.start[i], self.start[i + 1])
        return self.ids[own].copy(), self.sizes[own].copy(), int(self.total[i])

    def prefixes(self, values: np.ndarray) -> np.ndarray:
        """Sums of the first 0 .. len values of each row, rows one after the other."""
        run = np.r_[values[:0].sum(keepdims=True), np.cumsum(values, dtype=values.dtype)]
        owner, place = _ragged(self.len + 1)
        return run[self.start[owner] + place] - run[self.start[owner]]

    def lcps(self) -> np.ndarray:
        """LCP of each row with the one before; -1 for the first."""
        out = np.full(len(self.len), -1, np.int64)
        shorter = np.minimum(self.len[1:], self.len[:-1])
        owner, place = _ragged(shorter)
        apart = np.flatnonzero((self.ids[self.start[owner + 1] + place] != self.ids[self.start[owner] + place]).any(axis=1))
        out[1:] = shorter
        which, at = np.unique(owner[apart], return_index=True)
        out[1 + which] = place[apart[at]]
        return out


_NODE = (
    "open boolean, p1 bigint, p2 bigint, depth bigint, q1 bigint, q2 bigint, conv_id bigint, parent_conv_id bigint, n bigint, children bigint, leaves bigint, "
    "saved bigint, prior bigint, ends string, ends_sha256 string, part int, block bigint, edge int, ids array<binary>, sizes array<bigint>, total bigint"
)
_COLUMNS = [x.split()[0] for x in _NODE.split(", ")]
_KINDS = {"open": pa.bool_(), "ends": pa.string(), "ends_sha256": pa.string(), "part": pa.int32(), "edge": pa.int32(), "ids": pa.list_(pa.binary()), "sizes": pa.list_(pa.int64())}


def _batch(rows: int, /, **columns) -> pa.RecordBatch:
    arrays = []
    for c in _COLUMNS:
        kind = _KINDS.get(c, pa.int64())
        arrays.append(pa.nulls(rows, kind) if c not in columns else columns[c] if isinstance(columns[c], pa.Array) else pa.array(columns[c], kind))
    return pa.RecordBatch.from_arrays(arrays, _COLUMNS)


def _edge(part: int, side: int, row: tuple[np.ndarray, np.ndarray, int]) -> pa.RecordBatch:
    """First (0) or last (1) conversation of a partition."""
    ids, sizes, total = row
    return _batch(1, part=[part], block=[side], ids=[[x.tobytes() for x in ids]], sizes=[sizes.tolist()], total=[total])


def block_nodes(block: _Block, before: tuple[np.ndarray, np.ndarray, int] | None, part: int, number: int) -> pa.RecordBatch:
    """The nodes of one block; parts of nodes where they touch its borders.  Without the row before the
    block (first of a partition), what depends on it is left to the edge's row."""
    rows, lcp = len(block.len), block.lcps()
    first = -1 if before is None else common_prefix(before[0], block.row(0)[0])
    owner, depth = _ragged(block.len + 1)  # candidate prefixes, rows one after the other
    begin = block.start[:-1] + np.arange(rows)
    left, right = extents(least_tables(lcp), owner, depth)
    at = np.flatnonzero(left == owner)
    node_of = np.full(len(owner), -1)
    node_of[at] = np.arange(len(at))
    lo, hi, d = owner[at], right[at], depth[at]
    n = hi - lo + 1
    # the smallest member, by the same kind of table
    tables, level = least_tables(block.conv), np.floor(np.log2(n)).astype(np.int64)
    least = np.zeros(len(at), np.int64)
    for j in np.unique(level):
        own = level == j
        least[own] = np.minimum(tables[j][lo[own]], tables[j][hi[own] - (1 << j) + 1])
    place = np.arange(len(block.ids)) - np.repeat(block.start[:-1], block.len)
    hashes = [block.prefixes(mix(block.ids[:, k] ^ mix(place.astype(np.uint64) + lane))).view(np.int64) for k, lane in enumerate(_LANES)]
    size = block.prefixes(block.sizes)
    # the row before a row, also across the border
    all_lcp = np.r_[first, lcp[1:]]
    shared = size[begin + np.maximum(all_lcp, 0)]
    ended = (all_lcp < np.r_[before[2] if before else 0, block.total[:-1]]).astype(np.int64)
    known = np.r_[before is not None, np.ones(rows - 1, bool)]
    goes_on = (lo == 0) & known[0] & (first >= d)
    run_shared, run_ended = np.cumsum(shared), np.cumsum(ended)
    saved = run_shared[hi] - run_shared[lo] + np.where(goes_on, shared[0], 0)
    leaves = run_ended[hi] - run_ended[lo] + np.where(goes_on, ended[0], 0)
    # a row with an LCP below its length begins a child of the node at that depth over it
    child = np.flatnonzero((np.arange(rows) > 0) & (block.total > lcp))
    children = np.bincount(node_of[begin[left[begin[child] + lcp[child]]] + lcp[child]], minlength=len(at)) if len(child) else np.zeros(len(at), np.int64)
    starts_child = np.where(goes_on, (first == d) & (block.total[0] > d), block.total[lo] > d)
    children = children + np.where((lo == 0) & ~known[0], False, starts_child)
    open_ = ((lo == 0) & (~known[0] | (first >= d))) | (hi == rows - 1)
    up = np.where(d > 0, at - 1, at)  # the candidate one turn shorter, of the same row
    parent = node_of[begin[left[up]] + depth[up]]
    # conversations that end at a node are its first rows, all alike
    same = np.r_[False, (lcp[1:] == block.len[1:]) & (block.len[1:] == block.len[:-1])]
    group_ends = np.r_[np.flatnonzero(~same)[1:], rows]
    group_of = np.cumsum(~same) - 1
    ends: list[str | None] = [None] * len(at)
    digests = [EMPTY] * len(at)
    for k in np.flatnonzero(block.total[lo] == d).tolist():
        ends[k] = ",".join(map(str, block.conv[lo[k] : group_ends[group_of[lo[k]]]].tolist()))
        digests[k] = hashlib.sha256(ends[k].encode()).hexdigest()
    shown = pa.array(open_)
    text = lambda values, mask: pa.array([v if m else None for v, m in zip(values, mask.tolist(), strict=True)], pa.string())
    return _batch(
        len(at),
        open=shown,
        p1=hashes[0][at], p2=hashes[1][at], depth=d, q1=hashes[0][up], q2=hashes[1][up],
        conv_id=least,
        parent_conv_id=pa.array(least[parent], mask=open_[parent] | (d == 0)),
        n=n, children=children, leaves=leaves, saved=saved, prior=np.where(d > 0, size[up], 0),
        ends=text(ends, open_), ends_sha256=text(digests, ~open_),
        part=np.full(len(at), part, np.int32), block=np.full(len(at), number),
        edge=pa.array(np.full(len(at), part, np.int32), mask=~((lo == 0) & ~known[0])),
    )


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[_Block]:
    for batch in batches:
        lengths = np.diff(batch.column("ids").offsets.to_numpy()) + 1
        ends, a = np.cumsum(lengths), 0
        while a < batch.num_rows:
            done = ends[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield _Block(batch.slice(a, b - a))
            a = b


def _nodes(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), None
        for number, block in enumerate(_blocks(batches, limit)):
            if before is None:
                yield _edge(part, 0, block.row(0))
            yield block_nodes(block, before, part, number)
            before = block.row(len(block.len) - 1)
        if before is not None:
            yield _edge(part, 1, before)

    return run


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the first conversation of each partition shares with the last one before it."""
    before = None
    for batch in batches:
        for i in range(batch.num_rows):
            block = _Block(batch.slice(i, 1))
            ids, sizes, total = block.row(0)
            if batch.column("block")[i].as_py() == 0:
                lcp = -1 if before is None else common_prefix(before[0], ids)
                ended = int(before is not None and lcp < before[2])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x], t) for x, t in ((batch.column("part")[i].as_py(), pa.int32()), (lcp, pa.int64()), (int(sizes[: max(lcp, 0)].sum()), pa.int64()), (ended, pa.int64()), (total, pa.int64()))],
                    ["edge", "lcp", "shared", "ended", "first_total"],
                )
            before = ids, sizes, total


def _hashed_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, joined by commas as they stream by in order."""
    open_, digest = None, None

    def done():
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in open_] + [pa.array([digest.hexdigest()])], ["p1", "p2", "depth", "ends_sha256"])

    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in ("p1", "p2", "depth")), strict=True)
        for key, piece in zip(keys, batch.column("ends").to_pylist(), strict=True):
            if key != open_:
                if open_ is not None:
                    yield done()
                open_, digest = key, hashlib.sha256(piece.encode())
            else:
                digest.update(f",{piece}".encode())
    if open_ is not None:
        yield done()


# --- the trie -------------------------------------------------------------------------------------


def prefix_trie(conversations: DataFrame, block_limit: int = CANDIDATES) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16).alias("id"),
        F.octet_length(text).cast("bigint").alias("size"),
    )
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), conversations.count() // TURNS + 1)
    rows, convs = rebuilt(*placed(turns, parts))
    # the first turn of a conversation that no other has at its place
    alone = rows.groupBy("pos", "id").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id")).filter("n = 1")
    cut = written(alone.groupBy("conv_id").agg(F.min("pos").alias("cut")), "cuts")
    rows = written(rows.join(cut, "conv_id", "left"), "cut-turns")
    tail = F.coalesce(F.col("pos") > F.col("cut"), F.lit(False))
    shared = rows.filter(~tail).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "id", "size"))).alias("s"))
    s = F.coalesce("s", F.array().cast("array<struct<pos:bigint,id:binary,size:bigint>>"))
    sequences = convs.join(shared, "conv_id", "left").select("conv_id", "total", s.getField("id").alias("ids"), s.getField("size").alias("sizes"))
    dealt = written(sequences, "sequences").repartitionByRange(parts, "ids", "conv_id").sortWithinPartitions("ids", "conv_id")
    nodes = written(dealt.mapInArrow(_nodes(block_limit), _NODE), "nodes")

    edges = nodes.filter("open IS NULL").select("part", "block", "ids", "sizes", "total", F.lit(0).cast("bigint").alias("conv_id"))
    edges = edges.repartition(1).sortWithinPartitions("part", "block")  # two rows for each partition
    edges = written(edges.mapInArrow(_edges, "edge int, lcp bigint, shared bigint, ended bigint, first_total bigint"), "edges")
    pieces = nodes.filter("open").join(edges, "edge", "left")
    goes_on = F.coalesce(F.col("lcp") >= F.col("depth"), F.lit(False))
    begins = F.col("edge").isNotNull() & (F.col("first_total") > F.col("depth")) & (~goes_on | (F.col("lcp") == F.col("depth")))
    merged = pieces.groupBy("p1", "p2", "depth").agg(
        F.first("q1").alias("q1"), F.first("q2").alias("q2"), F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"), F.first("prior").alias("prior"),
        F.sum(F.col("children") + begins.cast("bigint")).alias("children"),
        F.sum(F.col("leaves") + F.when(goes_on, F.col("ended")).otherwise(F.lit(0))).alias("leaves"),
        F.sum(F.col("saved") + F.when(goes_on, F.col("shared")).otherwise(F.lit(0))).alias("saved"),
    )
    key = ["p1", "p2", "depth"]
    ending = nodes.filter("open AND ends IS NOT NULL").select(*key, "part", "block", "ends")
    ending = ending.repartition(parts, *key).sortWithinPartitions(*key, "part", "block")
    ending = written(ending.mapInArrow(_hashed_ends, "p1 bigint, p2 bigint, depth bigint, ends_sha256 string"), "open-ends")
    merged = written(merged.join(ending, key, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY))), "open-nodes")

    columns = ("conv_id", "depth", "n", "children", "leaves", "saved", "prior", "ends_sha256")
    closed = nodes.filter("NOT open")
    under = closed.filter("parent_conv_id IS NULL").select("q1", "q2", *columns).unionByName(merged.select("q1", "q2", *columns))
    parents = merged.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    under = under.join(parents, ["q1", "q2", "depth"], "left").select(*columns, "parent_conv_id")
    found = closed.filter("parent_conv_id IS NOT NULL").select(*columns, "parent_conv_id").unionByName(under)
    found = found.select(
        "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"), (F.col("leaves") + 1).alias("n_leaves"),
        (F.col("saved") - (F.col("n") - 1) * F.col("prior")).alias("saved_tokens"), "ends_sha256",
    )
    long = lambda c: c.cast("bigint")
    last = F.col("pos") + 1 == F.col("total")
    private = rows.filter(tail).select(
        "conv_id", (F.col("pos") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"), long(F.lit(1)).alias("n_convs"), long(F.when(last, 0).otherwise(1)).alias("n_children"),
        long(F.lit(1)).alias("n_leaves"), long(F.lit(0)).alias("saved_tokens"), F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(EMPTY)).alias("ends_sha256"),
    )
    return found.unionByName(private)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id, turn
  FROM conversations WHERE conv_id IS NOT NULL),
placed AS (
  SELECT conv_id, id, strlen(text) AS size,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) - 1 AS pos FROM t),
crc AS (  -- CRC-32 of the decimal id: a byte is mixed in, then eight shifts (999) follow
  SELECT DISTINCT conv_id, xor(4294967295, list_reduce(
           list_concat([4294967295], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 999, 999, 999, 999, 999, 999, 999, 999]))),
           lambda c, o: CASE WHEN o = 999 THEN xor(c >> 1, 3988292384 * (c & 1)) ELSE xor(c, o) END)) AS code FROM placed),
convs AS (SELECT conv_id, code % 9 AS h, conv_id - conv_id % 5 AS base FROM crc),
heads AS (
  SELECT c.conv_id, p.pos, p.id, p.size FROM convs c JOIN placed p ON p.conv_id = c.base AND p.pos < c.h),
taken AS (SELECT conv_id, count(*) AS m FROM heads GROUP BY conv_id),
turns AS (
  SELECT * FROM heads UNION ALL
  SELECT p.conv_id, p.pos - c.h + coalesce(m, 0), p.id, p.size
  FROM placed p JOIN convs c USING (conv_id) LEFT JOIN taken USING (conv_id) WHERE p.pos >= c.h),
seq AS (
  SELECT conv_id, coalesce(list(id ORDER BY pos) FILTER (id IS NOT NULL), []) AS ids, list(size ORDER BY pos) AS sizes, count(id) AS total
  FROM convs LEFT JOIN turns USING (conv_id) GROUP BY conv_id),
prefixes AS (
  SELECT conv_id, d AS depth, total, sha256(array_to_string(ids[1:d], ',')) AS node,
         CASE WHEN d > 0 THEN sha256(array_to_string(ids[1:d - 1], ',')) END AS parent,
         CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size
  FROM seq, range(0, total + 1) r(d)),
nodes AS (
  SELECT node, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (total = depth), '')) AS ends_sha256
  FROM prefixes GROUP BY node, depth),
kids AS (SELECT parent, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids ON kids.parent = nodes.node AND kids.depth = nodes.depth),
below AS (
  SELECT DISTINCT a.node AS top, a.depth AS top_depth, b.node, b.depth
  FROM prefixes a JOIN prefixes b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
sums AS (
  SELECT top, top_depth, count(*) FILTER (f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.size) AS saved_tokens
  FROM below JOIN full_nodes f ON f.node = below.node AND f.depth = below.depth GROUP BY top, top_depth)
SELECT f.conv_id, f.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves,
       s.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM full_nodes f JOIN sums s ON s.top = f.node AND s.top_depth = f.depth
LEFT JOIN nodes p ON p.node = f.parent AND p.depth = f.depth - 1
"""
