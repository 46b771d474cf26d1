"""Leaks: exact and edited copies are found, clean documents aren't; alignment against a plain one."""

import random

import numpy as np

from claimscope.llm import decontaminate as dc


def plain_alignment(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_scores():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 12, 40)
    items = np.zeros((40, 12), dtype=np.uint64)
    windows = np.ones((40, 20), dtype=np.uint64)
    for k, n in enumerate(sizes):
        items[k, :n] = rng.integers(2, 6, n)
        windows[k, : 8 + k % 12] = rng.integers(2, 6, 8 + k % 12)
    score, _ = dc.smith_waterman(items, sizes, windows)
    for k, n in enumerate(sizes):
        assert score[k] == plain_alignment(items[k, :n].tolist(), windows[k, : 8 + k % 12].tolist())


def _case():
    rng = random.Random(8)
    words = ["the", "of", "and", "in", "to"] * 12 + [f"w{k}" for k in range(500)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.randrange(15, 60)).capitalize() + ".") for i in range(60)]
    docs, want = [], set()
    for d in range(240):
        body = text(rng.randrange(5, 400))
        if d % 3 == 0:
            i, item = rng.choice(items)
            w = item.split()
            if d % 2:
                for _ in range(len(w) // 6):  # paraphrase: one word in six
                    w[rng.randrange(len(w))] = rng.choice(["changed", "words é"])
            body = f"{body} {' '.join(w).upper() if d % 9 == 0 else ' '.join(w)}, {text(50)}"
            want.add((d, i))
        docs.append((d, body))
    docs += [(900, None), (901, ""), (902, "the of and " * 5_000), (903, "the")]
    items += [(100, None), (101, ""), (102, "two words"), (103, items[3][1])]
    return docs, items, want


def test_finds_copies_and_leaves_clean_documents(spark):
    docs, items, want = _case()
    want |= {(d, 103) for d, i in want if i == 3}  # a repeated item is matched too
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS item_id", "2 AS score", "'x' AS place")
    b = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "7 AS doc_id")
    found = dc.matches(d, b).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want
    text, item = dict(docs), dict(items)
    for r in found:
        if r["score"] == 1.0:
            passage = text[r["doc_id"]][r["start"] : r["stop"]]
            assert passage.lower().rstrip(".") == item[r["item_id"]].lower().rstrip(".")
    kept = {r["doc_id"] for r in dc.without_leaks(d, b).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in want}


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs, items, _ = _case()
    d = spark.createDataFrame(docs[:90], "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    whole = sorted((r["doc_id"], r["item_id"]) for r in dc.matches(d, b).collect())
    monkeypatch.setattr(dc, "BLOCK_WORDS", 800)
    assert sorted((r["doc_id"], r["item_id"]) for r in dc.matches(d, b).collect()) == whole


def test_empty_tables(spark):
    none_d = spark.createDataFrame([], "doc_id bigint, text string")
    none_b = spark.createDataFrame([], "item_id bigint, text string")
    d = spark.createDataFrame([(1, "a b c d e")], "doc_id bigint, text string")
    assert dc.matches(none_d, none_b).collect() == []
    assert dc.matches(d, none_b).collect() == []
    assert [r["doc_id"] for r in dc.without_leaks(d, none_b).collect()] == [1]


def _edited(rng, words, every, how):
    out = list(words)
    for k in range(every - 1, len(words), every):
        out[k] = {"replace": f"new{rng.random()}", "insert": f"{words[k]} new{rng.random()}", "delete": ""}[how]
    return " ".join(w for w in out if w)


def _scores(docs, items):
    """Score of every document and item by plain alignment."""
    code = {}
    split = lambda t: [code.setdefault(w, len(code)) for w in t.lower().replace(".", " ").split()]
    return {(d, i): plain_alignment(split(item), split(text)) / (2 * len(split(item))) for d, text in docs for i, item in items}


def _edit_case(copies):
    """Copies with an edit at every 4th to 10th word; ``copies``: exact copies elsewhere, copies of each edited one."""
    rng = random.Random(5)
    pool = [f"w{k}" for k in range(4_000)]
    text = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items, docs = [], []
    for every in range(4, 11):
        for how in ("replace", "insert", "delete"):
            item = text(rng.randrange(16, 60))
            items.append((len(items), item))
            docs += [(len(docs) + k, f"{text(20)} {item} {text(20)}") for k in range(copies[0])]
            leak = _edited(rng, item.split(), every, how)
            docs += [(len(docs) + k, f"{text(20)} {leak} {text(20)}") for k in range(copies[1])]
    return docs, items


def test_edited_copies_against_brute_force(spark, monkeypatch):
    for copies, rare in (((0, 1), 1000), ((1, 1), 1000), ((3, 1), 1000), ((1, 4), 2)):
        monkeypatch.setattr(dc, "RARE", rare)  # 2: most of the edited copies' own grams are common, the broken ones rare
        docs, items = _edit_case(copies)
        want = {k for k, s in _scores(docs, items).items() if s >= dc.MIN_SCORE}
        assert len(want) >= len(docs)
        found = dc.matches(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
        assert {(r["doc_id"], r["item_id"]) for r in found} == want, (copies, rare)


def test_bound_is_never_below_the_alignment():
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(30)]
    block = dc.Items(list(range(20)), [" ".join(rng.choice(words, rng.integers(1, 40))) for _ in range(20)])
    text, bounds, *_ = dc.words_of(dc.pa.array([" ".join(rng.choice(words, 400))], dc.pa.large_string()))
    item, first = np.arange(20), rng.integers(0, 300, 20)
    last = np.minimum(400, first + rng.integers(1, 120, 20))
    assert (block._bound(text, item, first, last) >= block._score(text, item, first, last)[0]).all()


def test_seeds_in_steps_give_the_same(spark, monkeypatch):
    docs, items, _ = _case()
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    whole = sorted(dc.matches(d, b).collect())
    block = next(dc.item_blocks(d, b, "text", "item_id", "text"))
    words, bounds, *_ = dc.words_of(dc.pa.array([t for _, t in docs], dc.pa.large_string()))
    at_once = block.aligned(words, bounds, dc.MIN_SCORE)
    assert len(at_once) == len(whole)
    monkeypatch.setattr(dc, "STEP_SEEDS", 50)
    assert block.aligned(words, bounds, dc.MIN_SCORE) == at_once


def test_long_passages_of_long_items_are_leaks(spark):
    rng = random.Random(6)
    text = lambda n: " ".join(f"w{rng.randrange(4_000)}" for _ in range(n))
    item = text(300)
    w = item.split()
    docs = [(0, f"{text(80)} {' '.join(w[120:220])} {text(80)}"), (1, f"{text(80)} {' '.join(w[-25:])}"), (2, f"{' '.join(w[:24])} {text(200)}"), (3, text(600))]
    edited = w[40:100]
    edited[9::10] = ["new"] * 6
    docs.append((4, f"{text(50)} {' '.join(edited)} {text(50)}"))
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(7, item)], "item_id bigint, text string")
    assert {r["doc_id"]: round(r["score"], 4) for r in dc.matches(d, b).collect()} == {0: 0.3333, 1: 0.0833, 4: 0.1717}
    assert sorted(r["doc_id"] for r in dc.without_leaks(d, b).collect()) == [2, 3]
    assert dc.matches(d, b, min_words=101).collect() == []
