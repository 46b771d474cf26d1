"""Kernel against its definition; held-out accuracy; gapped and spelled-out words; edge cases."""

import itertools
import random

import numpy as np
import pyarrow as pa

from claimscope.llm import toxicity as tox

INSULTS = ["idiot", "moron", "stupid", "worthless", "disgusting"]


def features(w):
    w, out, square = f"{tox.BORDER}{w}{tox.BORDER}", {}, 0.0
    for i, j, k in itertools.combinations(range(len(w)), 3):
        if k - i < tox.SPAN:
            key = w[i] + w[j] + w[k]
            out[key] = out.get(key, 0) + tox.DECAY ** (k - i - 2)
            square += tox.DECAY ** (2 * (k - i - 2))
    return out, square**0.5


def definition(a, b):
    (x, m), (y, n) = features(a), features(b)
    return sum(v * y.get(k, 0) for k, v in x.items()) / (m * n)


def dense_margin(model, text):
    """The worst margin of a text, all of its windows written out."""
    weights = {int(k): w for k, w in zip(model.keys, model.weights, strict=True)}
    found = [tox.FLOOR]
    sentences = [[p for p in (tox.plain(x) for x in y.split()) if p] for y in tox._SENTENCE.split(text)]
    shown = [w for words in sentences for w in [*words, *(f"{a}{tox.BORDER}{b}" for a, b in itertools.pairwise(words))]]
    for w in shown:
        x, norm = features(w)
        dot = sum(v * weights.get(ord(k[0]) | ord(k[1]) << 21 | ord(k[2]) << 42, 0.0) for k, v in x.items())
        found.append(dot / norm + model.bias)
    return max(found)


def corpus(n=700):
    rng = random.Random(11)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "st", "en", "ou", "ing", "tion"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5)))
    out = []
    for i in range(n):
        w = [word() for _ in range(rng.randrange(20, 200))]
        bad = rng.random() < 0.3
        if bad:
            for _ in range(rng.randrange(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(INSULTS))
        out.append((i, " ".join(w), int(bad)))
    return out


def test_kernel_follows_its_definition():
    words = ["idiot", "id1iot", "haha", "a", "hahahaha", "naïve"]
    got = tox.kernel_matrix(words, words)
    want = np.array([[definition(a, b) for b in words] for a in words])
    assert np.allclose(got, want)


def test_held_out_accuracy_and_edited_insults(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string").selectExpr("*", "1 AS score", "'x' AS scored_text")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id bigint, quality int, toxic int")
    model = tox.train(docs, labels)
    got = {r["doc_id"]: r for r in tox.score(docs, model).collect()}
    held = [(got[i]["score"], got[i]["predicted"], y) for i, _, y in rows if got[i]["held_out"]]
    pos, neg = [s for s, _, y in held if y], [s for s, _, y in held if not y]
    assert np.mean([a > b for a in pos for b in neg]) > 0.97
    assert np.mean([p == y for _, p, y in held]) > 0.95
    # linear folding equals the machine's words one by one, and edits keep most of a margin
    tests = pa.array(["he is an idiot", "he is an id-iot", "an idxiot there", "he is an i d i o t here", "MORON!", "", None, "thereon anher edthing", "x" * 5_000])
    margins = tox.worst_margins(model, tests)
    assert (margins[:5] > margins[7]).all()
    p = model.probability(margins)
    assert ((p >= 0) & (p <= 1)).all()
    assert p[5] == p[6] == model.probability(np.array([tox.FLOOR]))[0]


def test_every_score_is_that_of_the_dense_machine(spark):
    rows = corpus(240)
    model = tox.fit([t for _, t, _ in rows], [y for _, _, y in rows], 0.3, tox.FitSize(landmarks=80, common=300, pool=500, hard=200, mined=200, rounds=3))
    texts = [t[:300] for _, t, _ in rows[:60]] + ["a be i", "x", "", "Idiot! moron. stu pid", "naïve idi-ot thé ö"]
    got = tox.worst_margins(model, pa.array(texts))
    assert np.allclose(got, [dense_margin(model, t) for t in texts])


def test_two_words_that_insult_only_together():
    rng = random.Random(4)
    texts, y = [], []
    for i in range(800):
        w = [rng.choice(["the", "cat", "sat", "on", "warm", "mat", "today", "again"]) for _ in range(40)]
        bad = i % 3 == 0
        for part in (["get lost"] if bad else ["get", "lost"]):
            w.insert(rng.randrange(5, 35), part)
        if not bad and "get lost" in " ".join(w):
            continue
        texts.append(" ".join(w) + ".")
        y.append(int(bad))
    model = tox.fit(texts[:600], y[:600], 0.3)
    p = model.probability(tox.worst_margins(model, pa.array(texts[600:])))
    held = np.array(y[600:])
    assert p[held == 1].min() > 0.3 > p[held == 0].max()
    p = model.probability(tox.worst_margins(model, pa.array(["now get lost.", "now get. lost it", "now geet lost you", "lost get"])))
    assert p[0] > 0.3
    assert p[2] > p[1]
    assert p[1] < 0.3 > p[3]


def test_copies_of_a_document_are_no_evidence_and_long_labelled_texts_are_left_out(spark):
    rows = corpus(600)
    copied = next(t for _, t, y in rows if y)
    copies = [(1_000 + i, copied + ' ' * i, 1) for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in [*rows, *copies]] + [(5_000, "clean " * 200_000)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in [*rows, *copies]] + [(5_000, 1)], "doc_id bigint, toxic int")
    got = {r.doc_id: r.score for r in tox.score(docs, tox.train(docs, labels)).collect()}
    pos, neg = [got[i] for i, _, y in rows if y], [got[i] for i, _, y in rows if not y]
    assert np.mean([a > b for a in pos for b in neg]) > 0.97
    assert got[5_000] < 0.3


def test_no_labels_one_class_no_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (None, "b"), (2, None), (2, None)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r["score"] for r in tox.score(docs, tox.train(docs, none)).collect()} == {0.0}
    one = spark.createDataFrame([(1, 1), (1, 1), (None, 1), (2, None)], "doc_id bigint, toxic int")
    rows = tox.score(docs, tox.train(docs, one)).collect()
    assert len(rows) == 4
    assert all(0 <= r["score"] <= 1 for r in rows)
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert tox.score(empty, tox.train(empty, none)).collect() == []
