"""Sketches against exact shingle sets, and the successor comparison against a list."""

import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from claimscope.llm import fingerprints as fp


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def _docs(n=120):
    rng = random.Random(9)
    words = [f"v{k}" for k in range(400)]
    out, text = [], ""
    for i in range(n):
        kind = i % 6
        if kind == 0:
            text = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 900)))
        elif kind < 4:
            w = text.split()
            w[rng.randrange(len(w))] = "é😀"
            text = " ".join(w)
        elif kind == 4:
            text = text + ""
        out.append((n - i, text))
    return [*out, (500, None), (501, ""), (502, "one"), (503, "two words")]


def test_successor_rows(spark):
    rows = _docs()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "0 AS part", "1 AS extra", "'x' AS tie").repartition(7)
    got = {r["doc_id"]: r for r in fp.compare_with_successor(df).collect()}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    assert len(got) == len(order)
    for k, (i, text) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + nxt[:cut]
        r = got[i]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for other, key in ((edited, "near_edited"), (nxt, "near_next")):
            a, b = shingles(text), shingles(other)
            exact = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(r[key] - exact) < (1e-9 if len(a | b) < fp.K else 0.12), (i, key)
    by_text = {}
    for i, text in order:
        assert by_text.setdefault(text, got[i]["fingerprint"]) == got[i]["fingerprint"]


def test_single_repeated_null_and_no_rows(spark):
    one = fp.compare_with_successor(spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")).collect()
    assert [(r["doc_id"], r["near_next"]) for r in one] == [(1, 1.0)]
    many = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, "x y z"), (None, "a b c"), (None, None)], "doc_id bigint, text string")
    assert sorted(str(r["doc_id"]) for r in fp.compare_with_successor(many).collect()) == ["1", "1", "1", "None", "None"]
    assert fp.compare_with_successor(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_merged_parts_equal_the_whole(spark):
    rng = random.Random(1)
    parts = [(k % 3, " ".join(f"t{rng.randrange(3000)}" for _ in range(400))) for k in range(9)] + [(7, ""), (7, None)]
    df = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(parts)], "doc_id bigint, key bigint, text string")
    sketches = fp.sketch(df).join(df.select("doc_id", "key"), "doc_id")
    got = {r["key"]: r["fingerprint"] for r in fp.merged(sketches, "key").collect()}
    for key in (0, 1, 2, 7):
        whole = np.zeros(0, np.uint64)
        for k, t in parts:
            if k == key:
                whole = fp.merge(whole, fp.sketch_texts([t or ""])[0])
        assert got[key] == fp.to_string(whole)


def test_estimates():
    texts = [" ".join(f"a{k}" for k in range(n)) for n in (6_000, 3_000)]
    a, b = fp.sketch_texts(texts)
    assert fp.distinct_count(a) == pytest.approx(5_996, rel=0.2)
    assert fp.containment(b, a) > 0.85
    assert fp.containment(a, b) == pytest.approx(0.5, abs=0.12)
    assert fp.resemblance(a, a) == 1.0
    assert np.array_equal(fp.from_string(fp.to_string(a)), a)


def test_ranges_are_even_where_ids_repeat(spark):
    """Four fifths of the rows without an id, some with one id, one range to a task; every row meets its successor."""
    rng = random.Random(4)
    rows = [(None if k % 5 else (7 if k % 2 else k), " ".join(f"u{rng.randrange(500)}" for _ in range(12))) for k in range(4_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    dealt = fp.with_successor(df, "doc_id", "text", parts=48)
    found = [(r["task"], r["part"], r["n"]) for r in dealt.filter("NOT extra").groupBy(F.spark_partition_id().alias("task"), "part").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert all(task == part for task, part, _ in found)
    sizes = [n for _, _, n in found]
    assert sum(sizes) == len(rows)
    assert len(found) > 40
    assert max(sizes) < 2 * len(rows) / 48
    order = sorted(((i if i is not None else fp.LEAST, tie, t) for i, t, tie in df.select("doc_id", "text", F.xxhash64("text")).collect()), reverse=True)
    follows = {}
    for k, (_, _, text) in enumerate(order):
        nxt = order[(k + 1) % len(order)][2]
        cut = len(text) // 3
        follows[text] = hashlib.sha256((text[: len(text) - cut] + nxt[:cut]).encode()).hexdigest()
    got = fp.compare_with_successor(df).collect()
    assert sorted(r["edited_sha256"] for r in got) == sorted(follows.values())


def test_ranges_follow_the_bytes(spark):
    df = spark.createDataFrame([(k, "x" * 1_000) for k in range(100)], "doc_id bigint, text string")
    assert fp.ranges(df, range_bytes=1_000) == 101
    least = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert fp.ranges(df) == least


def test_cuts_of_one_id_keep_the_order():
    """The range number never falls along descending (id, tie)."""
    rng = np.random.default_rng(2)
    ids = rng.integers(-3, 4, 5_000)
    ids[:1_000] = fp.LEAST
    ties = rng.integers(-(1 << 63), (1 << 63) - 1, 5_000, dtype=np.int64)
    ties[:4] = [-(1 << 63), (1 << 63) - 1, 0, -1]
    order = np.lexsort((ties, ids))[::-1]
    part = fp._range_of([fp.LEAST] * 9 + [-1, 0, 0, 0, 2]).func(pd.Series(ids[order]), pd.Series(ties[order])).to_numpy()
    assert (np.diff(part) >= 0).all()
    assert part[0] == 0 and part[-1] == 13
    assert (fp._range_of([]).func(pd.Series(ids), pd.Series(ties)) == 0).all()
