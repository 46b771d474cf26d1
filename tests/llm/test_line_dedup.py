"""Line dedup against a dictionary, the perfect hash, and the index of a hot line."""

import random
import re

import numpy as np
import pyarrow as pa

from claimscope.llm import line_dedup
from claimscope.llm.line_dedup import PerfectHash, dedup_lines

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_chars=20, min_docs=3):
    holders: dict[str, list] = {}
    for r, (i, t) in enumerate(rows):
        for k in {x.strip(BLANK).translate(LOWER) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                holders.setdefault(k, []).append((r, i))
    last = {k: max(-(1 << 63) if i is None else i for _, i in v) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        own = -(1 << 63) if i is None else i
        kept = [x for x in lines if last.get(x.strip(BLANK).translate(LOWER), own) == own]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    rng = random.Random(3)
    pool = [f"A common line number {k} é that repeats" for k in range(30)] + ["short", "", "   ", "exactly twenty chars", "nineteen characters"]
    rows = [(i, "\n".join(rng.choice(pool) + rng.choice(["", " ", "\t"]) if rng.random() < 0.6 else f"own line {i} {rng.random()}" for _ in range(rng.randrange(0, 12)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "\n\n"), (1003, "x" * 50_000), (None, pool[0]), (None, pool[1])]
    rows += [(7, rows[7][1]), (7, rows[7][1])]  # repeated rows
    rows += [(2000 + k, "The one line that very many documents hold\nrest %d" % k) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS kept", "2 AS block", "'x' AS sort_id")
    got = sorted([tuple(r) for r in dedup_lines(df).select("doc_id", "n_lines", "n_dropped", "kept").collect()], key=repr)
    assert got == brute(rows)


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 20_000).astype(np.uint64))
    ph = PerfectHash.build(keys)
    slots = ph.slots(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))
    assert PerfectHash.build(keys[:0]).slots(keys[:3]).tolist() == [-1, -1, -1]


def test_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_words_of_the_key():
    assert re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", "\t a b \r") == "\t a b \r".strip(BLANK)


def test_rows_of_one_id_spread_over_blocks(spark, monkeypatch):
    rng = random.Random(4)
    pool = [f"A common line number {k} that repeats" for k in range(30)]
    text = lambda i: "\n".join(rng.choice(pool) if rng.random() < 0.5 else f"own line {i} {rng.random()}" for _ in range(5))
    rows = [(None if i % 3 == 0 else 77 if i % 3 == 1 else i, text(i)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted([tuple(r) for r in dedup_lines(df).select("doc_id", "n_lines", "n_dropped", "kept").collect()], key=repr)
    assert got == brute(rows)

    def rows_of_blocks(min_chars, carry):
        def run(docs, hits):
            n = docs.num_rows
            cols = {c: docs.column(c) for c in carry} | {"kept": docs.column("text")}
            return pa.table(cols | {"n_lines": pa.array([n] * n, pa.int64()), "n_dropped": pa.array([0] * n, pa.int64())})

        return run

    monkeypatch.setattr(line_dedup, "_drop", rows_of_blocks)
    per_row = [r["n_lines"] for r in dedup_lines(df).collect()]
    blocks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert len(per_row) == 600 and max(per_row) < 1.5 * 600 / blocks  # a third of the rows and more by id alone
