"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. Every test item's three-word grams are counted in the whole corpus (documents that hold them).
2. Every gram that some document holds is a seed, so that an edited copy is found by any three
   words that it kept.  A seed of at most RARE documents is enough alone.  A commoner one is
   enough where its run of RUN grams has nothing rarer; elsewhere it takes a second seed of
   another run nearby (a common phrase comes alone, a passage that many documents copy doesn't).
3. Passages of documents around a seed are aligned with the item, word by word (match 2,
   mismatch and gap -1); the score is the best local alignment over that of the whole item.  A
   score of MIN_SCORE or more is a leak; so is, whatever the item's length, an alignment that
   counts as much as MIN_WORDS words copied in a row.  Passages whose words can't reach either in
   any order are not aligned.  A copy without three words in a row of the item has no seed and isn't found.

Test items are taken in blocks of bounded size that travel to the tasks, so documents are read
in place: no shuffle, no join key that can be hot, and memory bounded by a block and a chunk.

Words are runs of letters and digits (bytes above 7F count as letters), A-Z lower-cased.

Edge cases: null and empty texts, and items of fewer words than a gram, match nothing; repeated
items are matched each, repeated documents too; very long documents are aligned window by
window, whole; empty tables give no matches (and leave every document); only the named columns
are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.llm.common import PUNCTUATION, chunks, flat, lowered, mix, span_hashes, table, word_spans

GRAM = 3
RUN = 5  # grams of an item in a run
RARE = 1000  # documents that a gram is in at most to be enough alone
MIN_SCORE = 0.4
MIN_WORDS = 25  # copied words in a row that are a leak of any item; decides for items of more than 62 words
BLOCK_WORDS = 500_000  # words of the test items that are matched at a time
STEP_SEEDS = 1_000_000  # seeds found that one step holds; one text's are never parted
_MULT = np.uint64(0x9E3779B97F4A7C15)


def words_of(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, word bounds of each text, starts, ends, bytes)."""
    data, offsets = flat(column)
    starts, ends, bounds = word_spans(data, offsets, PUNCTUATION)
    return span_hashes(lowered(data), starts, ends), bounds, starts, ends, data


def gram_hashes(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of every gram that lies within one text."""
    if len(words) < GRAM:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(words) - GRAM + 1
    h = words[:n].copy()
    for k in range(1, GRAM):
        h = mix(h * _MULT + words[k : k + n])
    owner = np.searchsorted(bounds, np.arange(len(words)), side="right")
    at = np.flatnonzero(owner[:n] == owner[GRAM - 1 :])
    return h[at], at


class Lookup:
    """Positions of hashes in a sorted list, behind a sieve that most others don't pass."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.bits = max(16, int(len(hashes)).bit_length() + 6)
        self.sieve = np.zeros(1 << self.bits, dtype=bool)
        self.sieve[self._cell(hashes)] = True

    def _cell(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``h`` are listed, their place in the list)."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.sieve[self._cell(h)])
        at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
        ok = self.hashes[at] == h[maybe]
        return maybe[ok], at[ok]


def smith_waterman(items: np.ndarray, sizes: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score and its end (exclusive, in the window) of each row.  ``items`` and
    ``windows`` are padded with different values that equal no word."""
    n, width = windows.shape
    place = np.arange(1, width + 1, dtype=np.int32)
    h = np.zeros((n, width + 1), dtype=np.int32)
    best, end = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int64)
    for i in range(items.shape[1]):
        step = np.maximum(h[:, :-1] + np.where(windows == items[:, i : i + 1], 2, -1).astype(np.int32), h[:, 1:] - 1)
        np.maximum(step, 0, out=step)
        step = np.maximum.accumulate(step + place, axis=1) - place  # gaps in the item
        live = i < sizes
        h[live, 1:] = step[live]
        top = h.argmax(axis=1)
        score = h[np.arange(n), top]
        better = score > best
        best[better], end[better] = score[better], top[better]
    return best, end


class Items:
    """A block of test items: words, grams, and after :meth:`choose` the seeds."""

    def __init__(self, ids: list, texts: list[str]):
        self.ids = ids
        self.words, self.bounds, *_ = words_of(pa.array(texts, pa.large_string()))
        self.grams, self.gram_at = gram_hashes(self.words, self.bounds)
        self.distinct = np.unique(self.grams)
        self.seeds: Lookup | None = None
        self.has: np.ndarray | None = None  # made where it is used

    def choose(self, counts: np.ndarray) -> None:
        """``counts``: documents that hold each of ``distinct``."""
        rare = counts[np.searchsorted(self.distinct, self.grams)]
        item = np.searchsorted(self.bounds, self.gram_at, side="right") - 1
        run = (self.gram_at - self.bounds[item]) // RUN
        first = np.r_[True, (item[1:] != item[:-1]) | (run[1:] != run[:-1])] if len(run) else np.zeros(0, bool)
        held = (rare > 0) & (rare <= RARE)
        has_rare = np.bincount(np.cumsum(first) - 1, held)[np.cumsum(first) - 1] > 0 if len(run) else held
        chosen = np.flatnonzero(rare > 0)  # a gram that no document holds finds nothing
        chosen = chosen[np.argsort(self.grams[chosen], kind="stable")]
        hashes = self.grams[chosen]
        new = np.r_[True, hashes[1:] != hashes[:-1]] if len(hashes) else np.zeros(0, bool)
        self.seeds = Lookup(hashes[new])
        self.seed_item, self.seed_place = item[chosen], self.gram_at[chosen] - self.bounds[item[chosen]]
        self.seed_run, self.seed_alone = run[chosen], (held | ~has_rare)[chosen]
        self.seed_from = np.r_[np.flatnonzero(new), len(hashes)]

    def candidates(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, first word where the item would begin) of passages that share a seed: of
        beginnings that lie close together the first, whose window holds the others'."""
        grams, at = gram_hashes(words, bounds)
        hit, seed = self.seeds.find(grams)
        many = self.seed_from[seed + 1] - self.seed_from[seed]
        if many.sum() > STEP_SEEDS and len(bounds) > 2:
            half = len(bounds) // 2
            parts = [self.candidates(words[: bounds[half]], bounds[: half + 1]), self.candidates(words[bounds[half] :], bounds[half:] - bounds[half])]
            return tuple(np.concatenate(x) for x in zip(parts[0], (parts[1][0] + half, parts[1][1], parts[1][2] + bounds[half]), strict=True))
        which = np.repeat(self.seed_from[seed] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum()) if len(many) else np.zeros(0, np.int64)
        place = np.repeat(at[hit], many)
        item = self.seed_item[which]
        begin = place - self.seed_place[which]
        text = np.searchsorted(bounds, place, side="right") - 1
        slack = self._slack(item)
        cell = (begin - bounds[text] + (1 << 20) * slack) // slack
        run, alone = self.seed_run[which], self.seed_alone[which]
        order = np.lexsort((run, begin, item, text))
        text, item, begin, cell, slack, run, alone = (x[order] for x in (text, item, begin, cell, slack, run, alone))
        pair = (text[1:] == text[:-1]) & (item[1:] == item[:-1]) & (run[1:] != run[:-1]) & (begin[1:] - begin[:-1] <= slack[1:])
        enough = alone | np.r_[False, pair] | np.r_[pair, False] if len(text) else alone
        text, item, begin, cell = text[enough], item[enough], begin[enough], cell[enough]
        new = np.r_[True, (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (cell[1:] != cell[:-1])] if len(text) else np.zeros(0, bool)
        return text[new], item[new], begin[new]

    def _slack(self, item: np.ndarray) -> np.ndarray:
        """Words by which an edited copy may be longer or shorter before a place, about."""
        return np.maximum(4, (self.bounds[item + 1] - self.bounds[item]) // 3)

    def aligned(self, words: np.ndarray, bounds: np.ndarray, min_score: float, min_words: int = MIN_WORDS) -> list[tuple[int, int, float, int, int]]:
        """(text, item, score, first word, last word + 1) of the best leak of each text and item."""
        text, item, begin = self.candidates(words, bounds)
        best: dict[tuple[int, int], tuple[int, int, float, int, int]] = {}
        size = self.bounds[item + 1] - self.bounds[item]
        slack = self._slack(item)
        first = np.maximum(bounds[text], begin - slack)
        last = np.minimum(bounds[text + 1], begin + size + 2 * slack)
        order = np.argsort(size, kind="stable")
        at = 0
        while at < len(order):  # rows of like size together, some million cells at a time
            width = int(size[order[at]])
            n = max(1, 2_000_000 // max(1, 4 * width))
            rows = order[at : at + n]
            rows = rows[size[rows] <= 2 * width + 8]
            at += len(rows)
            most = self._bound(words, item[rows], first[rows], last[rows])
            rows = rows[(most / (2.0 * size[rows]) >= min_score) | (most >= 2 * min_words)]
            if not len(rows):
                continue
            score, end = self._score(words, item[rows], first[rows], last[rows])
            share = score / (2.0 * size[rows])
            for k in np.flatnonzero((share >= min_score) | (score >= 2 * min_words)).tolist():
                r = rows[k]
                stop = int(first[r] + end[k])
                own = self.words[self.bounds[item[r]] : self.bounds[item[r] + 1]]
                back, length = smith_waterman(own[::-1][None, :], np.array([len(own)]), words[first[r] : stop][::-1][None, :])
                key = (int(text[r]), int(item[r]))
                found = (*key, float(share[k]), stop - int(length[0]), stop)
                if key not in best or found[2] > best[key][2]:
                    best[key] = found
        return sorted(best.values())

    def _bound(self, words: np.ndarray, item: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """What the alignment of each window reaches at most: its best stretch at 2 for a word that the
        item has (by a bit table, that may have others too) and -1 for any other."""
        if self.has is None:
            size = np.diff(self.bounds)
            self.cells = 1 << np.ceil(np.log2(np.maximum(2, 8 * size))).astype(np.int64)
            self.cells_from = np.r_[0, np.cumsum(self.cells)]
            owner = np.repeat(np.arange(len(size)), size)
            self.has = np.zeros(self.cells_from[-1], dtype=bool)
            self.has[self.cells_from[owner] + (self.words & (self.cells[owner] - 1).astype(np.uint64)).astype(np.int64)] = True
        at = first[:, None] + np.arange(int((last - first).max()))
        word = words[np.minimum(at, len(words) - 1)]
        cell = self.cells_from[item][:, None] + (word & (self.cells[item] - 1).astype(np.uint64)[:, None]).astype(np.int64)
        total = np.cumsum(np.where(self.has[cell] & (at < last[:, None]), 2, -1), axis=1, dtype=np.int32)
        before = np.minimum.accumulate(np.minimum(np.c_[np.zeros(len(item), np.int32), total[:, :-1]], 0), axis=1)
        return (total - before).max(axis=1)

    def _score(self, words: np.ndarray, item: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.bounds[item + 1] - self.bounds[item]
        own = np.zeros((len(item), int(size.max())), dtype=np.uint64)
        win = np.ones((len(item), int((last - first).max())), dtype=np.uint64)
        for k in range(len(item)):
            own[k, : size[k]] = self.words[self.bounds[item[k]] : self.bounds[item[k] + 1]]
            win[k, : last[k] - first[k]] = words[first[k] : last[k]]
        return smith_waterman(own, size, win)


def _count_grams(distinct: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, counts = Lookup(distinct), np.zeros(len(distinct), dtype=np.int64)
        for part in chunks(batches, "text"):
            words, bounds, *_ = words_of(part.column(0))
            grams, at = gram_hashes(words, bounds)
            hit, place = lookup.find(grams)
            text = np.searchsorted(bounds, at[hit], side="right") - 1
            once = np.unique(text * np.int64(len(distinct)) + place)
            counts += np.bincount(once % max(1, len(distinct)), minlength=len(distinct))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some], pa.int64())], ["place", "docs"])

    return run


def item_blocks(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text: str) -> Iterator[Items]:
    """The test items in blocks of about BLOCK_WORDS words, each with its seeds chosen by the counts
    of its grams over all documents."""
    items = benchmark.select(F.col(item_col).alias("id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(total // (6 * BLOCK_WORDS)) + 1
    for b in range(n):
        rows = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b).orderBy("id", "text").collect()  # bounded by the block
        block = Items([r["id"] for r in rows], [r["text"] for r in rows])
        counts = np.zeros(len(block.distinct), dtype=np.int64)
        if len(block.distinct):
            texts = docs.select(F.col(text_col).cast("string").alias("text"))
            found = texts.mapInArrow(_count_grams(block.distinct), "place bigint, docs bigint").groupBy("place").agg(F.sum("docs").alias("docs"))
            for r in found.collect():  # one number per gram of the block
                counts[r["place"]] = r["docs"]
        block.choose(counts)
        yield block


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_score: float = MIN_SCORE, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document row and test item that leaks into it: the ids, score, and the passage
    (start, stop in code points)."""
    kinds = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, `{item_col}` {benchmark.schema[item_col].dataType.simpleString()}"
    schema = f"{kinds}, score double, start bigint, stop bigint"

    def finder(block: Items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in chunks(batches, "text"):
                words, bounds, starts, ends, data = words_of(part.column(1))
                found = block.aligned(words, bounds, min_score, min_words)
                if not found:
                    continue
                _, offsets = flat(part.column(1))
                points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
                base = points[offsets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array([f[0] for f in found])),
                        pa.array([block.ids[f[1]] for f in found]),
                        pa.array([f[2] for f in found], pa.float64()),
                        pa.array([int(points[starts[f[3]]] - base[f[0]]) for f in found], pa.int64()),
                        pa.array([int(points[ends[f[4] - 1]] - base[f[0]]) for f in found], pa.int64()),
                    ],
                    [id_col, item_col, "score", "start", "stop"],
                )

        return run

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    out = None
    for block in item_blocks(docs, benchmark, text_col, item_col, item_text):
        part = rows.mapInArrow(finder(block), schema)
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_score: float = MIN_SCORE, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, without those that a test item leaks into."""

    def keeper(block: Items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in chunks(batches, text_col):
                words, bounds, *_ = words_of(part.column(part.schema.get_field_index(text_col)))
                leaky = np.zeros(part.num_rows, dtype=bool)
                leaky[[f[0] for f in block.aligned(words, bounds, min_score, min_words)]] = True
                yield part.filter(pa.array(~leaky))

        return run

    for block in item_blocks(docs, benchmark, text_col, item_col, item_text):
        docs = docs.mapInArrow(keeper(block), docs.schema)
    return docs


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
