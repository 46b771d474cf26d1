"""The pipeline on a small planted corpus, stage by stage against brute force."""

import hashlib
import random
import sys
from pathlib import Path

import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp

sys.path.insert(0, str(Path(__file__).parent))
from test_line_dedup import brute as lines_brute  # noqa: E402
from test_near import brute as near_brute  # noqa: E402

public_tokenizers = pytest.importorskip("public_tokenizers")
INSULTS = ["idiot", "moron", "stupid", "worthless"]


def corpus():
    rng = random.Random(21)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "st", "en", "ou", "ing", "tion"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5)))
    text = lambda n: "\n".join(" ".join(word() for _ in range(rng.randrange(4, 15))) for _ in range(n))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(8)]
    docs, labels, kinds = [], [], {}

    def add(body, kind, toxic=0):
        docs.append((len(docs), body))
        kinds[len(kinds)] = kind
        if body:
            labels.append((len(docs) - 1, 1, toxic))

    for i in range(300):
        add(text(rng.randrange(3, 12)), "clean")
        if i % 4 == 0:
            w = text(6).split(" ")
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(INSULTS))
            add(" ".join(w), "toxic", 1)
        if i % 10 == 0:
            add(docs[-1][1] if kinds[len(kinds) - 1] == "clean" else docs[-2][1], "copy")
        if i % 12 == 0:
            add(text(3) + " " + rng.choice(items)[1].upper() + " " + text(2), "leak")  # inside a line of its own, so that line dedup keeps it
        if i % 9 == 0:
            add("The line which every licence repeats in full\n" + text(8), "line")
    add(None, "empty")
    add("", "empty")
    return docs, labels, items, kinds


def test_stages_and_run(spark, tmp_path):
    docs, labels, items, kinds = corpus()
    base = str(tmp_path)
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{base}/benchmark.parquet")
    stage = dict(cp.STAGES)
    read = spark.read.parquet(f"{base}/documents.parquet")

    clean = cp.written(stage["toxicity"](spark, read, base), "t1")
    assert clean.columns == list(cp.COLUMNS)
    kept = {r["doc_id"]: r["text"] for r in clean.collect()}
    toxic = {i for i, k in kinds.items() if k == "toxic"}
    assert len(toxic - kept.keys()) >= 0.95 * len(toxic)
    assert len(set(kinds) - toxic - kept.keys()) <= 0.02 * len(kinds)

    lines = cp.written(stage["line_dedup"](spark, clean, base), "t2")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in lines.collect()}
    want = {i: t for i, _, _, t in lines_brute(sorted(kept.items()))}
    assert {i: t for i, (t, _) in got.items()} == want
    assert all(n == len(t) for t, n in got.values())

    single = cp.written(stage["near_duplicates"](spark, lines, base), "t3")
    left = {r["doc_id"]: r["text"] for r in single.collect()}
    classes = near_brute(list(want.items()), 5, 80, 100)
    assert left.keys() == {i for i, (_, c) in classes.items() if c == i}

    safe = cp.written(stage["decontamination"](spark, single, base), "t4")
    rest = {r["doc_id"]: r["text"] for r in safe.collect()}
    assert left.keys() - rest.keys() == {i for i in left if kinds[i] == "leak"}

    ids = {r["doc_id"]: r["ids"] for r in stage["bpe"](spark, safe, base).collect()}
    ref = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert ids == {i: ref.encode(t, add_special_tokens=False).ids for i, t in rest.items()}

    whole = {r["doc_id"]: (r["ids"], r["ids_sha256"]) for r in cp.run(spark, base).collect()}
    assert whole == {i: (x, hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest()) for i, x in ids.items()}


def test_empty_tables(spark, tmp_path):
    base = str(tmp_path)
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{base}/benchmark.parquet")
    assert cp.run(spark, base).collect() == []
