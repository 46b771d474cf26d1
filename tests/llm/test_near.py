"""Near-duplicate classes against all pairs, components against union-find."""

import random
import re

import pytest

from claimscope.llm import near
from claimscope.llm.components import components
from claimscope.llm.near import near_duplicates, one_per_class

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def find(up, x):
    while up[x] != x:
        x = up[x]
    return x


def brute(rows, size, num, den):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    ids = sorted(sets)
    up = {i: i for i in ids}
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            both = len(x & y)
            if x and y and both * den >= num * (len(x) + len(y) - both):
                p, q = find(up, ids[a]), find(up, ids[b])
                up[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(up, i)) for i in ids}


@pytest.mark.parametrize(("size", "num", "den"), [(4, 85, 100), (5, 80, 100)])
def test_families_of_edited_copies(spark, size, num, den):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    base = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(3)]
    rows = []
    for i in range(260):
        w = rng.choice(base).split()
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = rng.choice([*words, f"n{i}"])
        rows.append((i, "  ".join(w).upper() if i % 7 == 0 else " ".join(w)))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "a b"), (1004, "A  b"), (1005, "a"), (1006, "x " * 3000), (1007, "x " * 2999)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "0 AS node", "1 AS n", "2 AS component")
    got = {r[0]: (r[1], r[2]) for r in near_duplicates(df, size=size, num=num, den=den).collect()}
    assert got == brute(rows, size, num, den)


def test_large_buckets_list_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr("claimscope.llm.near.LARGE", 8)
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    base = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(4)]
    rows = []
    for i in range(240):
        w = rng.choice(base).split()
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = rng.choice([*words, f"n{i}"])
        rows.append((i, " ".join(w)))
    got = {r[0]: (r[1], r[2]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), size=4, num=85, den=100).collect()}
    assert got == brute(rows, 4, 85, 100)


def test_repeated_rows_null_ids_and_no_rows(spark):
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (9, "A b c d e f")]
    got = sorted([tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), size=4, num=85, den=100).collect()], key=repr)
    assert got == sorted([(3, 3, 3), (3, 3, 3), (None, 3, None), (9, 3, 3)], key=repr)
    assert near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_components_of_chains_stars_and_cliques(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 50)] + [(300 + a, 300 + b) for a in range(8) for b in range(a)]
    rng.shuffle(links)
    up = {x: x for pair in links for x in pair}
    for a, b in links:
        p, q = find(up, a), find(up, b)
        up[max(p, q)] = min(p, q)
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect())
    assert got == {x: find(up, x) for x in up}


def test_rows_that_share_an_id_are_texts_of_their_own(spark):
    rng = random.Random(9)
    text = lambda: " ".join(f"w{rng.randrange(2_000)}" for _ in range(60))
    a, b, c, d = text(), text(), text(), text()
    rows = [(1, a, 0), (1, b, 1), (2, a, 2), (3, b + " more", 3), (1, c, 4), (1, c, 5), (1, c + " end", 6), (4, d, 7), (5, d, 8)]
    rows += [(6, None, 9), (6, "", 10), (None, a, 11), (None, a, 12)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, row int")
    kept = [r["row"] for r in one_per_class(df).collect()]
    assert {0, 1, 7, 9, 10, 11, 12} == {r for r in kept if r not in (4, 5, 6)}
    assert len(kept) == 8  # and one of the copies of c
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in near_duplicates(df, size=5, num=80, den=100).collect()}
    assert got[(2, 56)] == got[(3, 57)] == 1 and got[(4, 56)] == got[(5, 56)] == 4


def test_classes_of_one_id_do_not_merge(spark):
    """Copies of two texts that one id has: two classes, each keeps its row."""
    rng = random.Random(10)
    a, b = (" ".join(f"w{rng.randrange(2_000)}" for _ in range(60)) for _ in range(2))
    df = spark.createDataFrame([(5, a), (5, b), (6, a + " x"), (7, b + " y"), (3, b + " z")], "doc_id bigint, text string")
    got = {(r[0], r[1]): r[2] for r in near_duplicates(df, size=4, num=85, den=100).collect()}
    assert got == {(5, 57): got[(5, 57)], (6, 58): 5, (7, 58): 3, (3, 58): 3}
    assert {(r["doc_id"], r["text"]) for r in one_per_class(df).collect()} == {(5, a), (3, b + " z")}


def test_many_identical_rows_are_one_candidate(spark, monkeypatch):
    """Three near texts, each in 200 identical rows: every set is verified once."""
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join([*base[:k], "x", *base[k + 1 :]]) for k in (3, 30, 50)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts) for _ in range(200)], "doc_id bigint, text string")
    seen = {}
    write = near.written

    def spy(df, name):
        seen.setdefault(name, []).append(write(df, name))
        return seen[name][-1]

    monkeypatch.setattr(near, "written", spy)
    rows = near.near_duplicates(docs, size=4, num=60, den=100).collect()
    assert len(rows) == 600
    assert {r.component_id for r in rows} == {0}
    assert max(df.count() for df in seen["candidate-sets"]) <= 3
