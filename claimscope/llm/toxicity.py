"""Toxicity: a subsequence string-kernel support vector machine with Nystroem landmarks.

A sentence is a bag of windows: its words, and its pairs of adjacent words with the border between
them.  The kernel of two windows counts the (possibly gapped) three-character subsequences that they
share, borders included, each weighted by DECAY per skipped character, over the norms of the windows'
occurrences; an inserted or exchanged character leaves most of them alike, and a pair holds those that
cross its border.  Landmarks span a Nystroem feature space; the machine is trained there on labelled
sentences as bags: a sentence of a toxic document stands for its worst window, once the machine finds
one in it, a sentence of a clean document for all of its windows, the worst of which are mined.

As the machine is linear in the kernel, all landmarks fold into one weight per subsequence.  A window's
sum is that of its words and of the six characters about the border, so each distinct word and border
of a chunk is summed once.  A document's score is the calibrated margin of its worst window.

Words are runs without blanks, lower-cased, without punctuation; a sentence ends where a word ends with
one of .!?; runs of three or more single characters ("i d i o t") are joined into a word as well, and
words over LONG characters are read in overlapping windows, so whole texts of any length are scored.

The fit uses at most FIT_TOXIC and FIT_CLEAN labelled rows (those of the least hash of the id) of at
most FIT_TEXT_BYTES each and FIT_BYTES together, in one task on an executor; only the folded weights
reach the driver.  FitSize bounds what of their windows takes part.  Everything else is one pass over
all documents without a shuffle.

Edge cases: null and empty texts have no word and get the lowest score; labels without a
document, repeated or null labels are left out of the fit; without labels of both classes every
score is the share of toxic labels (0 without labels); repeated rows are scored each; an empty
table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.llm.common import chunks, table, written

FIT_TOXIC, FIT_CLEAN = 1_500, 4_500  # labelled rows of each class that the fit reads at most
FIT_TEXT_BYTES = 1 << 16  # bytes of a labelled text, beyond which the fit doesn't use it
FIT_BYTES = 1 << 25  # bytes of all labelled texts that the fit reads
DECAY = 0.6
SPAN = 5  # characters that one subsequence may span
BLOCK = 8_000  # words whose subsequences are held at a time
FIT_BLOCK = 1_000  # the same in the fit, whose rows are wider
LONG = 32  # characters of a window of a longer word
FLOOR = -1.0  # margins below this count as this
THRESHOLD = 0.3
BORDER = "\x02"  # before, between and after the words of a window
REACH = SPAN - 2  # characters on either side of a border that a subsequence over it may reach
_STEP_BYTES = 2 << 20
_FIT_STEP = 1 << 19  # characters of sentences that the fit scans at a time
_NOT_WORD = re.compile(r"[\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


@dataclass(frozen=True)
class FitSize:
    """Bounds of the fit, beside its labelled rows: they don't depend on the corpus."""

    landmarks: int = 320
    common: int = 4_000  # clean words and pairs that most documents hold
    pool: int = 20_000  # clean words among which those most like the toxic windows are sought
    hard: int = 4_000  # of these, as many
    mined: int = 3_000  # clean windows that a round got wrong, for the next one
    rounds: int = 4


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, key, weight) of every subsequence occurrence of the bordered windows; the key packs three
    code points."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    code = np.frombuffer("".join([f"{BORDER}{w}{BORDER}" for w in words]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    out = []
    for last in range(2, SPAN):
        at = np.flatnonzero(owner[last:] == owner[: len(owner) - last]) if len(owner) > last else np.zeros(0, np.int64)
        for mid in range(1, last):
            key = code[at] | (code[at + mid] << np.uint64(21)) | (code[at + last] << np.uint64(42))
            out.append((owner[at], key, np.full(len(at), DECAY ** (last - 2))))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


def summed(owner: np.ndarray, key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences of one subsequence in one word added up."""
    order = np.lexsort((key, owner))
    owner, key, weight = owner[order], key[order], weight[order]
    new = np.r_[True, (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])] if len(owner) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return owner[at], key[at], np.add.reduceat(weight, at) if len(at) else weight


def _norms(owner: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Norm of each window's occurrences (a scaling by length: the kernel stays positive)."""
    return np.sqrt(np.maximum(np.bincount(owner, weight**2, n), 1e-12))


def kernel_matrix(words: list[str], landmarks: list[str], root: np.ndarray | None = None) -> np.ndarray:
    """Scaled kernel of every window with every landmark, mapped by ``root`` if given."""
    lo, lk, lw = subsequences(landmarks)
    lw = lw / _norms(lo, lw, len(landmarks))[lo]
    names, col = np.unique(lk, return_inverse=True)
    dense = np.zeros((len(names), len(landmarks)), dtype=np.float64)
    np.add.at(dense, (col, lo), lw)
    out = np.zeros((len(words), len(landmarks) if root is None else root.shape[1]))
    for first in range(0, len(words), FIT_BLOCK):
        part = words[first : first + FIT_BLOCK]
        found = subsequences(part)
        norms = _norms(found[0], found[2], len(part))
        o, k, w = summed(*found)
        w = w / norms[o]
        at = np.minimum(np.searchsorted(names, k), len(names) - 1)
        hit = names[at] == k
        o, at, w = o[hit], at[hit], w[hit]
        begins = np.flatnonzero(np.r_[True, o[1:] != o[:-1]]) if len(o) else np.zeros(0, np.int64)
        for a in range(0, len(begins), 50):
            b = begins[a : a + 50]
            end = begins[a + 50] if a + 50 < len(begins) else len(o)
            rows = dense[at[b[0] : end]]
            rows *= w[b[0] : end, None]
            rows = np.add.reduceat(rows, b - b[0], axis=0)
            out[first + o[b]] = rows if root is None else rows @ root
    return out


def squared_hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Primal linear support vector machine (squared hinge) by Newton steps; the last weight is the bias."""
    width = x.shape[1] + 1
    w = np.zeros(width)
    keep = ridge * np.r_[np.ones(width - 1), 1e-3]
    active = np.ones(len(y), dtype=bool)
    for _ in range(rounds):
        square, right = np.diag(keep), np.zeros(width)
        for first in range(0, len(x), FIT_BLOCK):  # normal equations, block by block: x isn't copied
            rows = np.flatnonzero(active[first : first + FIT_BLOCK]) + first
            xa = np.c_[x[rows], np.ones(len(rows))]
            right += xa.T @ (cost[rows] * y[rows])
            square += (xa * cost[rows, None]).T @ xa
        w = np.linalg.solve(square, right)
        now = y * (x @ w[:-1] + w[-1]) < 1
        if (now == active).all():
            break
        active = now
    return w


@dataclass
class Model:
    """One weight per subsequence, the bias, and the calibration of a document's worst margin."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0
    constant: float | None = None

    def __post_init__(self):
        self.sieve = np.zeros(1 << 20, dtype=bool)
        self.sieve[self._cell(self.keys)] = True

    SCHEMA = "keys binary, weights binary, bias double, slope double, offset double, constant double"

    def dumps(self) -> pa.RecordBatch:
        values = (self.keys.tobytes(), self.weights.tobytes(), self.bias, self.slope, self.offset, self.constant)
        kinds = (pa.binary(), pa.binary(), *[pa.float64()] * 4)
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [f.split()[0] for f in self.SCHEMA.split(", ")])

    @classmethod
    def loads(cls, row) -> Model:
        return cls(np.frombuffer(row["keys"], np.uint64), np.frombuffer(row["weights"], np.float64), row["bias"], row["slope"], row["offset"], row["constant"])

    @staticmethod
    def _cell(key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def _weighed(self, key: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The machine's weight of each occurrence."""
        out = np.zeros(len(key))
        maybe = np.flatnonzero(self.sieve[self._cell(key)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.keys, key[maybe]), len(self.keys) - 1)
            out[maybe] = np.where(self.keys[at] == key[maybe], self.weights[at], 0.0) * weight[maybe]
        return out

    def sums(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Machine's sum and squared norm of each window."""
        dot, square = np.zeros(len(words)), np.zeros(len(words))
        for i in range(0, len(words), BLOCK):
            n = len(words[i : i + BLOCK])
            owner, key, weight = subsequences(words[i : i + BLOCK])
            dot[i : i + n] = np.bincount(owner, self._weighed(key, weight), n)
            square[i : i + n] = np.bincount(owner, weight**2, n)
        return dot, square

    def border_sums(self, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of the subsequences that cross a border, given the REACH code points on either
        side of it (rows; 0: none)."""
        code = np.insert(around, REACH, ord(BORDER), axis=1).astype(np.uint64)
        dot, square = np.zeros(len(code)), np.zeros(len(code))
        for a in range(REACH):
            for c in range(REACH + 1, min(a + SPAN, code.shape[1])):
                there = np.flatnonzero((code[:, a] > 0) & (code[:, c] > 0))
                for b in range(a + 1, c):
                    key = code[there, a] | (code[there, b] << np.uint64(21)) | (code[there, c] << np.uint64(42))
                    weight = np.full(len(there), DECAY ** (c - a - 2))
                    dot[there] += self._weighed(key, weight)
                    square[there] += weight**2
        return dot, square

    def margin(self, dot: np.ndarray, square: np.ndarray) -> np.ndarray:
        """FLOOR at least."""
        return np.maximum(FLOOR, dot / np.sqrt(np.maximum(square, 1e-12)) + self.bias) if len(self.keys) else np.full(len(dot), FLOOR)

    def margins(self, words: list[str]) -> np.ndarray:
        return self.margin(*self.sums(words))

    def probability(self, worst: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(worst), self.constant)
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * worst + self.offset, -30, 30)))


def plain(piece: str) -> str:
    return piece if piece.isalnum() and piece.islower() else _NOT_WORD.sub("", piece.lower())


def windows(word: str) -> list[str]:
    if len(word) <= LONG:
        return [word]
    return [word[i : i + LONG] for i in range(0, len(word) - LONG // 2, LONG // 2)]


@dataclass
class Scan:
    """The words of some texts, by their distinct pieces, and the margins of all windows."""

    names: list[str]  # plain form of each distinct piece
    which: np.ndarray  # piece of each word that has one, text after text
    owner: np.ndarray  # text of each word
    sentence: np.ndarray  # number of each word's sentence, over all texts
    pair: np.ndarray  # words that the next word of the same sentence follows
    spelled: list[tuple[int, int, str]]  # (text, sentence, window) of joined single characters


def scan(texts: pa.Array) -> Scan:
    split = pc.utf8_split_whitespace(pc.fill_null(texts, "").cast(pa.string()))
    bounds = split.offsets.to_numpy()
    coded = pc.dictionary_encode(split.values)
    pieces = coded.dictionary.to_pylist()
    names = [plain(p) for p in pieces]
    which = coded.indices.to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    stops = np.fromiter((p[-1:] in ".!?" for p in pieces), dtype=bool, count=len(pieces))
    said = np.fromiter(map(bool, names), dtype=bool, count=len(names))
    if len(which):
        new = np.r_[True, stops[which[:-1]] | (owner[1:] != owner[:-1])]
        sentence, keep = np.cumsum(new) - 1, said[which]
        which, owner, sentence = which[keep], owner[keep], sentence[keep]
    else:
        sentence = which
    pair = np.flatnonzero(sentence[1:] == sentence[:-1])
    single = np.fromiter((len(n) == 1 for n in names), dtype=bool, count=len(names))[which] if len(which) else np.zeros(0, bool)
    spelled = []
    if single.any():  # runs of three or more single characters within one text
        begins = np.flatnonzero(single & ~np.r_[False, single[:-1] & (owner[1:] == owner[:-1])])
        ends = np.flatnonzero(single & ~np.r_[single[1:] & (owner[1:] == owner[:-1]), False]) + 1
        for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
            if b - a >= 3:
                spelled += [(int(owner[a]), int(sentence[a]), w) for w in windows("".join([names[i] for i in which[a:b]]))]
    return Scan(names, which, owner, sentence, pair, spelled)


def _code_points(texts: list[str], width: int) -> np.ndarray:
    """Code points of short texts, one row each, 0 behind their ends."""
    raw = "".join([t.ljust(width, "\0") for t in texts]).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(raw, np.uint32).reshape(len(texts), width)


def window_margins(model: Model, s: Scan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Margins of all words, pairs and spelled-out words of a scan."""
    words, source = [], []
    for i, n in enumerate(s.names):
        if n:
            for w in windows(n):
                words.append(w)
                source.append(i)
    source = np.array(source, dtype=np.int64)
    dot, square = model.sums(words)
    by_name = np.full(len(s.names) + 1, FLOOR)
    np.maximum.at(by_name, source, model.margin(dot, square))
    # a pair: both words (of a long one all of its windows' sums), and the border between them
    name_dot = np.bincount(source, dot, len(s.names)) if len(source) else np.zeros(len(s.names))
    name_square = np.bincount(source, square, len(s.names)) if len(source) else np.zeros(len(s.names))
    pair_margin = np.zeros(0)
    if len(s.pair):
        heads = [(n + BORDER)[:REACH] for n in s.names]
        tails = [(BORDER + n)[-REACH:] for n in s.names]
        head_of, head = _distinct(heads)
        tail_of, tail = _distinct(tails)
        left, right = s.which[s.pair], s.which[s.pair + 1]
        borders, at = np.unique(tail_of[left] * len(head) + head_of[right], return_inverse=True)
        ends = np.fliplr(_code_points([t[::-1] for t in tail], REACH))[borders // len(head)]  # next to the border last
        cross, cross_square = model.border_sums(np.c_[ends, _code_points(head, REACH)[borders % len(head)]])
        pair_margin = model.margin(name_dot[left] + name_dot[right] + cross[at], name_square[left] + name_square[right] + cross_square[at])
    return by_name[s.which], pair_margin, model.margins([w for _, _, w in s.spelled])


def _distinct(texts: list[str]) -> tuple[np.ndarray, list[str]]:
    places = {t: i for i, t in enumerate(dict.fromkeys(texts))}
    return np.fromiter((places[t] for t in texts), dtype=np.int64, count=len(texts)), list(places)


def worst_margins(model: Model, texts: pa.Array) -> np.ndarray:
    """Margin of the worst window of each text."""
    s = scan(texts)
    out = np.full(len(texts), FLOOR)
    single, pair, spelled = window_margins(model, s)
    for owner, value in ((s.owner, single), (s.owner[s.pair], pair)):
        begins = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
        if len(begins):
            out[owner[begins]] = np.maximum(out[owner[begins]], np.maximum.reduceat(value, begins))
    if s.spelled:
        np.maximum.at(out, np.array([t for t, _, _ in s.spelled]), spelled)
    return out


def _shown(s: Scan, k: int) -> str:
    return s.names[s.which[k]]


def worst_windows(model: Model, s: Scan) -> dict[int, tuple[float, str]]:
    """Sentence -> (margin, window) of its worst word, pair or spelled-out word."""
    single, pair, spelled = window_margins(model, s)
    value = np.r_[single, pair]
    sentence = np.r_[s.sentence, s.sentence[s.pair]]
    order = np.lexsort((value, sentence))
    last = order[np.flatnonzero(np.r_[sentence[order][1:] != sentence[order][:-1], True])] if len(order) else order
    out = {}
    for k in last.tolist():
        if k < len(single):
            shown = max(windows(_shown(s, k)), key=lambda w: model.margins([w])[0]) if len(_shown(s, k)) > LONG else _shown(s, k)
        else:
            at = int(s.pair[k - len(single)])
            shown = f"{_shown(s, at)}{BORDER}{_shown(s, at + 1)}"
        out[int(sentence[k])] = (float(value[k]), shown)
    for (_, at, w), m in zip(s.spelled, spelled.tolist(), strict=True):
        if m > out.get(at, (FLOOR, ""))[0]:
            out[at] = (m, w)
    return out


def _steps(texts: Iterable[str]) -> Iterator[pa.Array]:
    """The texts in steps of bounded size: the fit holds one step's arrays."""
    step, held = [], 0
    for x in texts:
        step.append(x)
        held += len(x)
        if held >= _FIT_STEP:
            yield pa.array(step, pa.string())
            step, held = [], 0
    if step:
        yield pa.array(step, pa.string())


def _scans(sentences: list[str]) -> Iterator[Scan]:
    return map(scan, _steps(sentences))


def window_counts(sentences: list[str], pairs: set[str] | None = None) -> Counter:
    """Sentences that hold each word and pair (of pairs only those of ``pairs``, if given)."""
    out: Counter = Counter()
    for s in _scans(sentences):
        n = len(s.names)
        held = np.bincount(np.unique(s.owner * n + s.which) % n, minlength=n) if n else np.zeros(0, np.int64)
        for name, k in zip(s.names, held.tolist(), strict=True):
            if name and k:
                for w in windows(name):
                    out[w] += k
        both, at = np.unique(s.which[s.pair] * n + s.which[s.pair + 1], return_inverse=True)
        held = np.bincount(np.unique(s.owner[s.pair] * len(both) + at) % len(both), minlength=len(both)) if len(both) else both
        for code, k in zip(both.tolist(), held.tolist(), strict=True):
            shown = f"{s.names[code // n]}{BORDER}{s.names[code % n]}"
            if len(shown) <= 2 * LONG and (pairs is None or shown in pairs):
                out[shown] += k
    return out


def _worst_of(model: Model, sentences: list[str]) -> list[tuple[float, str]]:
    return [x for s in _scans(sentences) for x in worst_windows(model, s).values() if x[0] > FLOOR]


def fit(texts: list[str], toxic: list[int], prior: float, size: FitSize = FitSize()) -> Model:
    """Train on labelled documents; three quarters train, one quarter calibrates for the ``prior``."""
    none = Model(np.zeros(0, np.uint64), np.zeros(0), 0.0, constant=prior)
    # copies are no evidence of their own
    once = dict(zip(texts, toxic, strict=True))
    texts, y = list(once), np.array(list(once.values()))
    if not len(y) or y.min() == y.max():
        return none
    train_on = np.arange(len(y)) % 4 != 3
    # sentences count once, however many copies of a document hold them; clean documents' ones are clean
    clean_ones = dict.fromkeys(x for t, label, use in zip(texts, y, train_on, strict=True) if use and not label for x in _SENTENCE.split(t))
    toxic_ones = dict.fromkeys(x for t, label, use in zip(texts, y, train_on, strict=True) if use and label for x in _SENTENCE.split(t) if x not in clean_ones)
    bad, good = list(toxic_ones), list(clean_ones)
    n_pos, n_neg = max(1, len(bad)), max(1, len(good))
    # the first witnesses: windows that the toxic sentences share and the clean ones lack
    in_pos = window_counts(bad)
    tried = len(in_pos)
    in_pos = {w: k for w, k in in_pos.items() if k > 1}
    in_neg = window_counts(good, pairs=set(in_pos))
    witness = _telling(in_pos, in_neg, n_pos, n_neg, tried)
    if not witness:
        return none
    positive = sorted(witness, key=lambda w: (-witness[w], w))
    chosen = set(positive)
    clean = [w for w in sorted(in_neg, key=lambda w: (-in_neg[w], w)) if w not in chosen][: max(size.pool, size.common, size.landmarks)]
    del in_neg
    heads = positive[: size.landmarks // 2]
    # clean windows most like the witnesses are the hard ones
    like = kernel_matrix(clean[: size.pool], heads).max(axis=1) if clean else np.zeros(0)
    hard = [clean[i] for i in np.argsort(-like, kind="stable")[: size.hard].tolist()]
    marks = list(dict.fromkeys([*heads, *hard[: size.landmarks // 3], *clean[: size.landmarks // 6]]))
    gram = kernel_matrix(marks, marks)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    sound = values > 1e-6 * values[-1]
    root = vectors[:, sound] / np.sqrt(values[sound])  # the Nystroem map: kernel row @ root
    lo, lk, lw = subsequences(marks)
    lw = lw / _norms(lo, lw, len(marks))[lo]
    keys, at = np.unique(lk, return_inverse=True)
    negative = list(dict.fromkeys([*hard, *clean[: size.common]]))
    for turn in range(size.rounds):
        sample = [*positive, *negative]
        x = kernel_matrix(sample, marks, root)
        label = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
        weight = np.array([1 + np.log(max(1.0, witness[w])) for w in positive])
        cost = np.r_[weight / weight.mean() * max(1.0, 0.2 * len(negative) / len(positive)), np.ones(len(negative))]
        w = squared_hinge(x, label, cost, ridge=0.1)
        del x
        beta = root @ w[:-1]
        model = Model(keys, np.bincount(at, lw * beta[lo], len(keys)), float(w[-1]))
        if turn == size.rounds - 1:
            break
        # clean sentences whose worst window the machine gets wrong; toxic ones stand for their worst
        # windows.  One that is both goes where it is the more frequent by far: labels have errors
        wrong = Counter(v for m, v in sorted(_worst_of(model, good), reverse=True) if m > -0.9)
        found = Counter(v for m, v in _worst_of(model, bad) if m > 0)
        found = {v: n for v, n in found.items() if n * n_neg > 3 * wrong[v] * n_pos}
        if found:
            witness, positive = found, sorted(found, key=lambda v: (-found[v], v))
        mined = [v for v in wrong if v not in witness][: size.mined]
        negative = [v for v in dict.fromkeys([*negative, *mined]) if v not in witness]
    rest = ~train_on
    if (y[rest] == 1).sum() < 5 or (y[rest] == 0).sum() < 5:
        rest = np.ones(len(y), dtype=bool)
    margin = np.concatenate([worst_margins(model, a) for a in _steps(texts[i] for i in np.flatnonzero(rest).tolist())])
    model.slope, model.offset = _calibrate(margin, y[rest], prior)
    return model


def _calibrate(margin: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Logistic slope and offset by Newton steps, the classes weighted to the prior."""
    weight = np.where(y == 1, prior / max(1, (y == 1).sum()), (1 - prior) / max(1, (y == 0).sum())) * len(y)
    x = np.c_[margin, np.ones(len(margin))]
    w = np.zeros(2)
    target = np.where(y == 1, 1 - 1e-3, 1e-3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - target)) + 1e-3 * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(w[0], 0.0)), float(w[1])


def _telling(in_pos: dict[str, int], in_neg: Counter, n_pos: int, n_neg: int, tried: int) -> dict[str, float]:
    """Windows that toxic documents hold more often than chance allows for that many windows (log-likelihood
    ratio, Bonferroni); with few labels, when none is, the five most telling.  The training only starts
    from them."""
    total, score = n_pos + n_neg, {}
    for w, a in in_pos.items():
        b = in_neg[w]
        if a * n_neg > 3 * b * n_pos:
            g = a * np.log(a * total / ((a + b) * n_pos)) + (b * np.log(b * total / ((a + b) * n_neg)) if b else 0.0)
            score[w] = 2 * float(g)
    least = 2 * np.log(max(2, tried))
    found = {w: g for w, g in score.items() if g >= least}
    return found or dict(sorted(score.items(), key=lambda x: (-x[1], x[0]))[:5])


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: tuple[int, int] = (FIT_CLEAN, FIT_TOXIC)) -> Model:
    """Fit on at most ``fit_rows`` labelled rows (clean, toxic) that aren't held out."""
    known = labels.filter(~held_out(id_col) & F.col("toxic").isin(0, 1)).groupBy(F.col(id_col).cast("bigint").alias("fit_id")).agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.0
    chosen = None
    for label in (0, 1):
        part = known.filter(F.col("toxic") == label).orderBy(F.xxhash64("fit_id"), "fit_id").limit(fit_rows[label])
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = F.broadcast(written(chosen, "fit-rows"))  # two small columns, sum(fit_rows) rows at most
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("fit_id"), text.alias("text")).filter(F.octet_length("text") <= FIT_TEXT_BYTES).join(chosen, "fit_id")
    sample = rows.orderBy(F.xxhash64("fit_id"), "fit_id", F.xxhash64("text")).limit(sum(fit_rows)).select("text", "toxic")
    found = written(sample.mapInArrow(_fitted(prior), Model.SCHEMA), "toxicity-model").collect()  # one row: the folded weights
    return Model.loads(found[0]) if found else Model(np.zeros(0, np.uint64), np.zeros(0), 0.0, constant=prior)


def _fitted(prior: float):
    """One task fits on its rows, up to FIT_BYTES of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic, room = [], [], FIT_BYTES
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                room -= len(text.encode())
                if room >= 0:
                    texts.append(text)
                    toxic.append(label)
        yield fit(texts, toxic, prior).dumps()

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), threshold: float = THRESHOLD) -> DataFrame:
    """Per row: the id, the ``carry`` columns, held_out, score (0 to 1), predicted."""
    names = list(dict.fromkeys([id_col, *carry]))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "scored_text", _STEP_BYTES):
            p = model.probability(worst_margins(model, part.column(0)))
            cols = [part.column(i) for i in range(1, part.num_columns)]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())], [*names, "held_out", "score", "predicted"]
            )

    rows = docs.select(F.col(text_col).cast("string").alias("scored_text"), *[F.col(c) for c in names], F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"))
    return rows.mapInArrow(run, f"{kinds}, held_out boolean, score double, predicted int")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
