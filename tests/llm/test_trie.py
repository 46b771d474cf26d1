"""The trie against plain dictionaries over random conversations, in blocks and partitions of any size."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimscope.llm import trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, pos string, id string"


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            convs[c].append(((turn is not None, turn or 0, digest[:16]), (role, text)))
    turns = {c: [x for _, x in sorted(v, key=lambda x: x[0])] for c, v in convs.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        whole = tuple(turns.get(base, [])[:h] + own[h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].add(c)
        ends[whole].append(c)
    children = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, own in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(own) - 1) * len(node[-1][1].encode()) if node else 0
    out = []
    for node, own in members.items():
        listed = ",".join(map(str, sorted(ends.get(node, []))))
        up = min(members[node[:-1]]) if node else None
        out.append((min(own), len(node), up, len(own), children[node], leaves[node], saved[node], hashlib.sha256(listed.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, parts=None, **limits):
    df = spark.createDataFrame([(*r, 1, "p", "i") for r in rows], SCHEMA)
    got = trie.prefix_trie(df.repartition(parts) if parts else df, **limits)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


@pytest.mark.parametrize("limit", [1, 40, 1 << 17])
def test_random_conversations(spark, limit):
    rng = random.Random(limit)
    rows = []
    for c in rng.sample(range(-60, 400), 260):
        for t in range(rng.choice([1, 1, 2, 3, 6, 14])):
            rows.append((c, t, rng.choice(["user", "bot"]) if rng.random() < 0.1 else "user", rng.choice(["a", "a", "a", "bé", f"{c} {t}" * 3])))
    for c in range(1_000, 1_150):  # copies of one conversation of more turns than heads share
        rows += [(c, t, "user", "same") for t in range(14)]
    rng.shuffle(rows)
    assert found(spark, rows, 4, block_limit=limit) == brute(rows)


def test_one_conversation_with_most_rows(spark):
    rows = [(7, t, "user", "x" if t < 20 else f"turn {t}") for t in range(300)] + [(12, t, "user", "x") for t in range(40)] + [(5, 0, None, "only")]
    assert found(spark, rows, 3) == brute(rows)
    turns, _ = trie.placed(spark.createDataFrame([(c, t, b"%016d" % t, 1) for c, t, _, _ in rows], "conv_id bigint, turn bigint, id binary, size bigint"), 6)
    places = {(r.conv_id, r.pos): int(r.id) for r in turns.collect()}
    assert all(places[c, t] == t for c, t, _, _ in rows)


def test_nulls_ties_repeats_turnless_and_empty(spark):
    long = "é" * 100_000
    rows = [
        (1, 2, "user", "b"), (1, None, None, None), (1, 2, "user", "b"), (1, 2, "bot", "a"), (1, None, "user", long),
        (None, 1, "user", "nobody's"), (3, 1, "user", None), (6, 1, "", ""), (8, 1, "user", "x"), (5, 0, None, None), (2, 0, "user", long),
    ]
    want = brute(rows)
    assert found(spark, rows) == want
    assert want[0][3] >= 6  # the root has the turnless ones too
    assert found(spark, rows[5:6]) == []
    assert found(spark, []) == []
    alone = [(4, 0, "user", "hi")]  # its head is absent and longer than it is: no turn is left
    assert found(spark, alone) == brute(alone)


def test_extents_against_walking():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 64, 100):
        lcp = np.r_[-1, rng.integers(0, 4, n - 1)]
        tables = trie.least_tables(lcp)
        row, depth = np.repeat(np.arange(n), 5), np.tile(np.arange(5), n)
        left, right = trie.extents(tables, row, depth)
        for i, d, a, b in zip(row, depth, left, right, strict=True):
            l, r = i, i  # noqa: E741
            while l > 0 and lcp[l] >= d:
                l -= 1  # noqa: E741
            while r + 1 < n and lcp[r + 1] >= d:
                r += 1
            assert (a, b) == (l, r)


def test_ranges_split_copies(spark):
    """Equal conversations are dealt over partitions, so that no task gets them all."""
    rows = [(c, t, "user", f"t{t}") for c in range(0, 4_000, 5) for t in range(3)]
    got = found(spark, rows)
    assert got == brute(rows)
    df = spark.createDataFrame([(c, ["a"]) for c in range(800)], "conv_id bigint, ids array<string>")
    parts = df.repartitionByRange(8, "ids", "conv_id").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in parts) < 300
