"""BPE encoding and decoding in batched numpy merge rounds.

The symbols of many words lie in one flat array.  A round looks up every adjacent pair by
binary search in the sorted pair keys, takes the lowest rank of each word, merges it, and
retires the words that have no pair left.  Words repeat, so a step (some MB of text) encodes
each distinct white-space-free piece once.

Edge cases: null and empty text give no tokens and an empty decoded text; very long words
are merged like any other (whole, never cut); repeated rows and ids are encoded row by row;
an empty table gives an empty result; extra input columns are not carried.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.llm.common import chunks, table

STEP_BYTES = 6 << 20  # text bytes that are encoded together
MARK = "\0"  # begins a special token's string among pieces
NONE = np.int64(1 << 40)

_CONTROL = re.compile("[\0\x1c-\x1f]")  # some splitters take 1C-1F for blanks, the vocabulary's rule doesn't


def byte_characters() -> list[str]:
    """The printable character that byte-level BPE writes for each byte value."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in names):
        names[b] = chr(256 + k)
    return [names[b] for b in range(256)]


class Vocabulary:
    """Pair keys, ranks and token names of a BPE file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(pattern).findall
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.find_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.names = [""] * self.size
        for name, i in [*vocab.items(), *self.special.items()]:
            self.names[i] = name
        self.name_array = pa.array(self.names, pa.string())
        self.number_array = pa.array([str(i) for i in range(self.size)], pa.string())
        chars = byte_characters()
        self.inner = np.array([vocab.get(c, -1) for c in chars], dtype=np.int64)
        self.last = np.array([vocab.get(c + suffix, -1) for c in chars], dtype=np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        last = np.r_[np.flatnonzero(np.diff(keys[order])), len(order) - 1] if len(order) else order
        self.keys, self.ranks, self.made = keys[order][last], order[last], made
        # A merge is plain when no pair of what it makes ranks before it: then all its places in a word can
        # be merged at once; else only the first place is, as new pairs may come before the others.
        first = np.full(self.size, NONE)
        ranks = np.arange(len(merges))
        np.minimum.at(first, left, ranks)
        np.minimum.at(first, right, ranks)
        self.plain = first[made] > ranks

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(left), NONE)
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NONE)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all (non-empty) words in one array, and each word's bounds in it."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        sym = self.inner[raw]
        ends = np.cumsum(lengths)
        sym[ends - 1] = self.last[raw[ends - 1]]
        owner = np.repeat(np.arange(len(words)), lengths)
        known = sym >= 0  # a byte without a token is left out
        sym, owner = sym[known], owner[known]
        rank = self._pairs(sym, owner)
        out_sym, out_owner = [], []
        while len(sym):
            begins = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(rank, begins)
            spans = np.diff(np.r_[begins, len(sym)])
            active = np.repeat(lowest < NONE, spans)
            if not active.all():
                out_sym.append(sym[~active])
                out_owner.append(owner[~active])
                sym, owner, rank = sym[active], owner[active], rank[active]
                spans, lowest = spans[lowest < NONE], lowest[lowest < NONE]
                if not len(sym):
                    break
            places = np.flatnonzero(rank == np.repeat(lowest, spans))
            places = self._apart(places, owner, rank)
            sym[places] = self.made[rank[places]]
            keep = np.ones(len(sym), dtype=bool)
            keep[places + 1] = False
            merged = places - np.arange(len(places))  # places after the removals
            sym, owner, rank = sym[keep], owner[keep], rank[keep]
            changed = np.r_[merged, merged[merged > 0] - 1]
            rank[changed] = self._pairs_at(sym, owner, changed)
        if not out_sym:
            return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
        ids, owner = np.concatenate(out_sym), np.concatenate(out_owner)
        ids = ids[np.argsort(owner, kind="stable")]
        return ids, np.r_[0, np.cumsum(np.bincount(owner, minlength=len(words)))]

    def _pairs(self, sym: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Rank of the pair that begins at each symbol; the last of a word begins none."""
        rank = np.full(len(sym), NONE)
        at = np.flatnonzero(owner[1:] == owner[:-1])
        rank[at] = self.rank(sym[at], sym[at + 1])
        return rank

    def _pairs_at(self, sym: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        nxt = np.minimum(at + 1, len(sym) - 1)
        rank = self.rank(sym[at], sym[nxt])
        return np.where((at + 1 < len(sym)) & (owner[at] == owner[nxt]), rank, NONE)

    def _apart(self, places: np.ndarray, owner: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Of the lowest pairs' places those that one round merges, left to right."""
        word = owner[places]
        first = np.r_[True, word[1:] != word[:-1]]
        places = places[first | self.plain[rank[places]]]
        if len(places) > 1:  # of places that overlap (aaa), every other one from the left
            joined = np.r_[False, np.diff(places) == 1]
            run = np.flatnonzero(~joined)
            nth = np.arange(len(places)) - np.repeat(run, np.diff(np.r_[run, len(places)]))
            places = places[nth % 2 == 0]
        return places

    def normal(self, text: str) -> str:
        # lower-casing is character by character: no final sigma
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def words(self, text: str) -> list[str]:
        """Words of one text, where special tokens or control characters occur."""
        out: list[str] = []
        for k, part in enumerate(self.find_special.split(text) if self.find_special else [text]):
            out += [MARK + part] if k % 2 else [p if p[0] != MARK else " " + p for p in self.split(self.normal(part))]
        return out

    def pieces(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """White-space-free pieces of all texts, and each text's bounds in them."""
        plain = [None if _CONTROL.search(t) or (self.find_special and self.find_special.search(t)) else self.normal(t) for t in texts]
        split = pc.utf8_split_whitespace(pa.array([p or "" for p in plain], pa.string()))
        if None not in plain:
            return split.values, split.offsets.to_numpy()
        parts, sizes = [], []
        for k, p in enumerate(plain):
            parts.append(pa.array(self.words(texts[k]), pa.string()) if p is None else split[k].values)
            sizes.append(len(parts[-1]))
        return pa.concat_arrays(parts), np.cumsum([0, *sizes])

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, pa.Array, pa.Array, pa.Array]:
        """(number of tokens, decimal ids joined by one blank, token names joined by one blank, ids) of each text."""
        pieces, bounds = self.pieces(texts)
        distinct = pc.dictionary_encode(pieces)
        which = distinct.indices.to_numpy()
        words: list[str] = []
        counts: list[int] = []  # words of each distinct piece; -1 - id for a special token
        for p in distinct.dictionary.to_pylist():
            if p.isalpha():
                words.append(p)
                counts.append(1)
            elif p[:1] == MARK:
                counts.append(-1 - self.special[p[1:]])
            else:
                got = [p[1:]] if p[:1] == " " else self.split(p)
                words += got
                counts.append(len(got))
        n_words = np.array(counts, dtype=np.int64).reshape(-1)
        ids, of_words = self.encode([w.encode("utf-8", "surrogatepass") for w in words])
        ends = of_words[np.cumsum(np.maximum(n_words, 0))]
        if (n_words < 0).any():  # put the special tokens between
            at = np.flatnonzero(n_words < 0)
            ids = np.insert(ids, ends[at], -1 - n_words[at])
            ends = ends + np.cumsum(n_words < 0)
        tokens = np.diff(np.r_[0, ends])
        used = tokens[which] > 0
        before = np.r_[0, np.cumsum(used)][bounds]
        total = np.r_[0, np.cumsum(tokens[which])][bounds]
        out = []
        of_pieces = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(ids.astype(np.int32)))
        whole = pa.ListArray.from_arrays(pa.array(total, pa.int32()), of_pieces.take(pa.array(which)).flatten())
        for names in (self.number_array, self.name_array):
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), names.take(pa.array(ids)))
            joined = pc.binary_join(lists, " ").take(pa.array(which[used]))
            out.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(before, pa.int32()), joined), " "))
        return np.diff(total), *out, whole


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_decode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", values: tuple[str, ...] = ()) -> DataFrame:
    """Per row: the id column, n_tokens, ids_sha256, decoded_sha256, and of ``values`` those named:
    ids (array<int>), decoded (text).  The decoded text is the tokens' names joined by one
    blank, as a vocabulary without a decoder gives it."""
    kind = docs.schema[id_col].dataType.simpleString()
    kinds = {"ids": "array<int>", "decoded": "string"}
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + "".join(f", {v} {kinds[v]}" for v in values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        for part in chunks(batches, "text", STEP_BYTES):
            n, ids, decoded, whole = vocab.encode_texts([t or "" for t in part.column(1).to_pylist()])
            digest = [pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in texts], pa.string()) for texts in (ids, decoded)]
            cols = [part.column(0), pa.array(n, pa.int64()), *digest]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            for v in values:
                cols.append({"ids": whole, "decoded": decoded}[v])
                names.append(v)
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
