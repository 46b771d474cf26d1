"""Every order against plain filtering; the diagram's levels under swaps; edge cases."""

import itertools
import random
from collections import Counter

from pyspark.sql import functions as F

from claimscope.llm import audit

NAMES = "ABCDE"


def brute(rows):
    """rows: (part, failed letters, good, toxic)."""
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        lines, shapley = {}, Counter()
        for order in itertools.permutations(NAMES):
            left = own
            for k, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                fails = sum(f in r[1] for r in own)
                lines["".join(order), k] = (len(left), len(gone), fails - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone))
                shapley[f] += len(gone)
        for (order, k), v in lines.items():
            out[part, order, k] = (*v, shapley[order[k - 1]])
    return out


def test_plain_changes_lead_through_all_orders():
    for n in (1, 2, 3, 5):
        at, seen = list(range(n)), {tuple(range(n))}
        for k in audit.plain_changes(n):
            at[k], at[k + 1] = at[k + 1], at[k]
            seen.add(tuple(at))
        assert len(seen) == len(list(itertools.permutations(range(n))))


def test_swapped_diagram_equals_one_built_in_that_order():
    rng = random.Random(3)
    counts = {m: (rng.randrange(9), rng.randrange(5)) for m in rng.sample(range(32), 20)}
    d = audit.Diagram(5, counts, 2)
    for k in audit.plain_changes(5):
        d.swap(k)
        for f, kept, removed in d.steps():
            before = [g for g in d.order if d.order.index(g) < d.order.index(f)]
            clear = lambda m: not any(m >> g & 1 for g in before)
            for i in (0, 1):
                assert removed[i] == sum(c[i] for m, c in counts.items() if clear(m) and m >> f & 1)
                assert kept[i] == sum(c[i] for m, c in counts.items() if clear(m) and not m >> f & 1)
        # equal sub-diagrams are one node: a level never has more nodes than there are paths to it
        assert all(len(level) <= 2**i for i, level in enumerate(d.levels))


def test_orders_against_plain_filtering(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["en", "de", ""]), {f for f in NAMES if rng.random() < 0.4}, rng.random() < 0.3, rng.random() < 0.3) for _ in range(400)]
    data = [(p or None, *(f in fs for f in NAMES), bool(g), bool(t), "x") for p, fs, g, t in rows]
    df = spark.createDataFrame(data, "lang string, a boolean, b boolean, c boolean, d boolean, e boolean, good boolean, toxic boolean, mask string")
    got = audit.interactions(df, F.col("lang"), {f: F.col(f.lower()) for f in NAMES}, {"good": F.col("good"), "toxic": F.col("toxic")}).collect()
    want = brute(rows)
    assert len(got) == len(want)
    for r in got:
        assert (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) == want[r.part, r.filter_order, r.step]


def test_flags_of_odd_rows(spark):
    long = "word " * 300
    data = [
        (1, None, "en", 1), (2, "", None, 2), (3, "", "", 3), (4, long, "en", 4), (4, long, "en", 5), (5, long, "en", 6),
        (None, long, "en", 7), (None, None, None, 8), (6, " ".join(f"w{i}" for i in range(200)), "fr", 9), (7, "AB|" + "c" * 50, "fr", 10),
    ]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, lang string, digest int").withColumns({"words": F.lit(1), "part": F.lit("p"), "A": F.lit(True)})
    got = sorted(((r.id is None, r.id or 0, r.part or "", *(r[f] for f in NAMES)) for r in audit.quality_flags(docs).collect()))
    t, f = True, False
    assert got == [
        (False, 1, "en", t, f, f, f, f), (False, 2, "", t, f, f, f, t), (False, 3, "", t, f, f, f, t),
        (False, 4, "en", f, t, f, f, f), (False, 4, "en", f, t, f, f, f), (False, 5, "en", f, t, f, f, t),
        (False, 6, "fr", f, f, f, f, f), (False, 7, "fr", t, f, t, t, f),
        (True, 0, "", t, f, f, f, f), (True, 0, "en", f, t, f, f, f),
    ]
    empty = docs.limit(0)
    flags = audit.quality_flags(empty)
    assert audit.interactions(flags, F.col("part"), {f: F.col(f) for f in NAMES}, {}).collect() == []
