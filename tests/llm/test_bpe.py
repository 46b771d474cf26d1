"""BPE against the tokenizers library, text by text."""

import hashlib
import random

import pytest
from tokenizers import Tokenizer

from claimscope.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def _texts():
    rng = random.Random(7)
    odd = [
        None, "", "   ", "a", "a" * 650, "ha" * 3000, "!" * 1000, "İstanbul ΑΣ ΣΑΣ ΣΑ'S it's we'll 123 ½ ²",
        "<|startoftext|> hi <|endoftext|>x<|endoftext|", "a\x1cb\x1dc \0 d", "é ẛ̣ ﬁ Å", "中文字 안녕 👍🏽👍 x\x85y　z", "\0<|startoftext|>", "'s's 't''ll",
    ]
    odd += ["".join(rng.choice("abcdehinorst 'é中!1") for _ in range(200)) for _ in range(100)]
    return odd + ["repeated row", "repeated row"]


def test_matches_the_library(spark):
    texts = _texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumnRenamed("x", "ids")
    got = {r["doc_id"]: r for r in bpe.encode_decode(df, PATH, values=("ids", "decoded")).collect()}
    ref = Tokenizer.from_file(PATH)
    for i, t in enumerate(texts):
        want = ref.encode(t or "", add_special_tokens=False).ids
        decoded = ref.decode(want, skip_special_tokens=False)
        assert got[i]["ids"] == want, repr(t)
        assert got[i]["n_tokens"] == len(want)
        assert got[i]["decoded"] == decoded
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_one_place_a_round_where_new_pairs_come_first(tmp_path):
    """A merge whose product pairs at a lower rank is merged at one place at a time, as a queue would."""
    import json

    merges = [["ab", "a"], ["a", "b"]]
    vocab = {c: i for i, c in enumerate(["a", "b", "a</w>", "b</w>", "ab", "aba"])}
    spec = {
        "added_tokens": [], "pre_tokenizer": {"pretokenizers": [{"pattern": {"Regex": r"\S+"}}]},
        "model": {"vocab": vocab, "merges": merges, "end_of_word_suffix": "</w>"},
    }
    path = tmp_path / "v.json"
    path.write_text(json.dumps(spec))
    ids, bounds = bpe.Vocabulary(str(path)).encode([b"abababb"])
    # a b a b a b b</w>: ab at 0, then (ab, a) -> aba, then b stays, ab at 4
    assert ids.tolist() == [vocab["aba"], vocab["b"], vocab["ab"], vocab["b</w>"]]
    assert bounds.tolist() == [0, 4]


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, ids string, n_tokens int")
    assert bpe.encode_decode(df, PATH).collect() == []
