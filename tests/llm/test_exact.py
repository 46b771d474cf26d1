"""The filter's promises, an index that grows, shrinks and overflows against plain dictionaries, edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimscope.llm import exact
from claimscope.llm.common import shared_path

SCHEMA = "doc_id bigint, text string, row string, digest string, shard int"


def brute(rows):
    groups = {}
    for k, (i, t) in enumerate(rows):
        t = t or ""
        groups.setdefault("".join(c for c in t if c not in exact.BLANKS), []).append((-len(t), i is None, i or 0, k))
    out = []
    for members in groups.values():
        members.sort()
        for m in members:
            out.append((rows[m[3]][0], rows[members[0][3]][0], len(members), m is members[0]))
    return sorted(out, key=repr)


def listed(index):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in index.groups().collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "r", "d", 1) for i, t in rows], SCHEMA)


def test_no_false_negatives_through_insertion_deletion_and_overflow():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 2**63, 6_000).astype(np.uint64)
    t = exact.Cuckoo(7_000)
    assert all(t.insert(keys[i : i + 500]) for i in range(0, 6_000, 500))
    assert t.has(keys).all()
    assert t.used == 6_000
    gone, kept = keys[:3_000], keys[3_000:]
    t.delete(gone)
    assert t.has(kept).all()
    assert t.has(gone).mean() < 0.01
    again = exact.Cuckoo.loads(t.dumps())
    assert again.used == 3_000
    assert again.has(kept).all()
    small = exact.Cuckoo(100)
    before = small.places.copy()
    assert not small.insert(keys[:5_000])  # full: nothing is inserted
    assert (small.places == before).all()
    assert not exact.Cuckoo(64).insert(np.full(60, keys[0]))  # only eight places for one key: moving ends
    assert exact.Cuckoo(64).insert(np.full(8, keys[0]))


@pytest.mark.parametrize("expected", [8, 4_000])
def test_additions_and_removals(spark, expected):
    """With 8 expected keys per shard every batch overflows and shards are built anew."""
    rng = random.Random(7)
    text = lambda: " ".join(rng.choice("ab") for _ in range(rng.randrange(1, 11)))
    index = exact.LiveIndex(spark, shared_path(spark, "live-test"), 3, expected)
    live = {}
    for turn in range(3):
        new = [(1_000 * turn + k, rng.choice([text(), text() + " ", "\t" + text(), f"{turn} {k}"])) for k in range(400)]
        new += [(9_000 + 100 * turn + k, "hot text") for k in range(100)]
        index.add(frame(spark, new))
        live |= dict(new)
        gone = rng.sample(sorted(live), 150)
        if turn == 1:
            gone += [i for i, t in live.items() if t == "hot text"]
        index.remove(spark.createDataFrame([(i,) for i in gone], "doc_id bigint"))
        removed = {"".join(live[i].split()) for i in gone}
        for i in gone:
            live.pop(i, None)
        assert listed(index) == brute(list(live.items()))
        # the filter knows each live digest once, and hardly any other
        digests = index.content().select("digest").distinct()
        assert index.maybe(digests).count() == digests.count()
        used = sum(exact.Cuckoo.loads(r.places).used for r in index.filters().collect())
        assert digests.count() <= used <= digests.count() + 2
        dead = removed - {"".join(t.split()) for t in live.values()}
        asked = spark.createDataFrame([(t,) for t in dead], "t string").select(F.unhex(F.sha2("t", 256)).alias("digest"))
        assert index.maybe(asked).count() <= 2


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "a"), (None, "a"), (5, "a b"), (4, "ab"), (6, "a  b"), (6, "a  b"), (7, "x" * 200_000), (8, "x" * 200_000 + " "), (9, "a b")]
    index = exact.index_of(frame(spark, rows))
    assert listed(index) == brute(rows)
    empty = exact.index_of(frame(spark, rows).limit(0))
    assert empty.groups().collect() == []
    empty.add(frame(spark, rows))
    assert listed(empty) == brute(rows)


def test_false_hits_are_inserted_after_all(spark):
    """Among this many digests some look known to the filter; each is in it once in the end, and none is a copy."""
    docs = spark.range(120_000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    index = exact.index_of(docs, shard_keys=30_000)
    assert sum(exact.Cuckoo.loads(r.places).used for r in index.filters().collect()) == 120_000
    assert index.groups().filter("kept AND group_size = 1 AND keep_id = doc_id").count() == 120_000
    assert index.version > 1  # the second pass that inserts false hits
