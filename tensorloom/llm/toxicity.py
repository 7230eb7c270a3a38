"""Toxicity: a support vector machine on a gapped-subsequence string kernel with Nyström landmarks.

The kernel compares two words by their common subsequences of three letters within a span of SPAN letters, where a mark
stands before and after each word, and by whether they are equal; each inserted letter costs a factor DECAY, so
"id.iot", "idxiot" and unseen endings of an insult's stem stay close to it, and a clean word that is the bare stem can
still be told from it. Subsequences of letters of any script are hashed to BUCKETS places. Of scripts without blanks
between words all runs of two to four letters count as words.
Labels are of texts, the witnesses in them are not known (a multiple-instance machine): words that stand in toxic texts
far oftener than chance allows are the first ones. Words that clean texts share with them by stem weigh by how often
they occur, and a witness is asked for a margin that grows with its odds. A text is judged by its sentences: the worst
word, how many words lie beyond the plane, and how many of these a sentence has; the scale from there to a probability
is fitted on texts that the machine in question has not seen. Nyström landmarks make the machine linear, and the sum
over landmarks folds into one weight for each place, so a word is scored by one sparse product.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bucket, give_back, lean
from .sentencepiece_codec import _pieces

SPAN, DECAY = 5, 0.6
#: Weight of the whole word, which tells a witness from a clean word that it begins with.
WHOLE = 2.0
#: Letters of a word that are compared at once; longer words are cut into overlapping windows of this length.
REACH = 24
BUCKETS = 1 << 21
_GAPS = [(i, j) for j in range(2, SPAN) for i in range(1, j)]
#: Bounds of the training sample (texts), of the clean words that a machine is shown, and of the landmarks.
MAX_TOXIC, MAX_CLEAN, MAX_NEGATIVES, LANDMARKS = 1_500, 3_000, 6_000, 256
#: Weight of clean words within the margin against all others; ridge of the scale; the largest margin that is asked for.
HARD, RIDGE, FIRM = 3.0, 0.05, 4.0
#: A word starts as a witness if words that were dealt to the texts by chance would give fewer than this many such words,
#: and if its odds to stand in a toxic text are this many times those of all words.
CHANCE, ODDS = 0.1, 8
THRESHOLD = 0.7
#: Entries of a task's table of word margins; a full table is dropped and filled anew.
TABLE_ENTRIES = 200_000
#: Characters of text whose words are lists at once, unless one text is longer.
PIECE_CHARS = 250_000
#: Words whose subsequences are in memory at once, and words of the sample whose contexts are sorted at once.
WORDS_AT_ONCE, CONTEXTS_AT_ONCE = 2_000, 250_000
#: Letters and separators have nothing in common and are taken for good, so that a text is read once.
_SPACED = re.compile(r"(?<!\S)[^\W_](?:[\s._*-]++[^\W_](?![^\W_])){3,}+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
#: Blocks of Han, Kana and Hangul.
_DENSE = re.compile("[\u2e80-\ua4cf\uac00-\ud7ff\uf900-\ufaff\U00020000-\U0003ffff]+")
_RUN = (2, 3, 4)


def _runs(word: str) -> Iterator[str]:
    """The parts of a word; of dense scripts all runs of _RUN letters, in order of their starts, or one letter alone."""
    at = 0
    for m in _DENSE.finditer(word):
        yield word[at : m.start()]
        run = m[0]
        yield from (run[i : i + n] for i in range(max(1, len(run) - 1)) for n in _RUN if i + n <= len(run) or n == 2)
        at = m.end()
    yield word[at:]


def sentences(text: str) -> list[list[str]]:
    """The lower-cased words of each sentence that has any (of dense scripts: runs of letters); each run of four or more
    single letters is one word, and one sentence, besides."""
    low = text.lower()
    dense = not low.isascii() and _DENSE.search(low)
    out = []
    for part in _SENTENCE.split(low):
        words = part.split()
        if dense:
            words = [x for w in words for x in _runs(w) if x]
        if words:
            out.append(words)
    return out + [[re.sub(r"[\W_]+", "", m)] for m in _SPACED.findall(low)]


def tokens(text: str) -> list[str]:
    """The words of all sentences."""
    return list(chain.from_iterable(sentences(text)))


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words' windows as rows of code points of letters between two marks, 0 after the last, and the word of each row.

    The last column is a number of the whole word where it fits one window, else 0.
    """
    kept = ["".join(filter(str.isalpha, w)) for w in words]
    parts, owner, whole = [], [], []
    for i, w in enumerate(kept):
        w = f"\x02{w}\x03" if w else w
        alone = zlib.crc32(w.encode("utf-8", "replace")) if 0 < len(w) <= REACH else 0
        for at in range(0, max(1, len(w) - REACH // 2), REACH // 2) if len(w) > REACH else (0,):
            parts.append(w[at : at + REACH])
            owner.append(i)
            whole.append(alone)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros((len(parts), REACH + 1), np.uint32)
    rows = np.repeat(np.arange(len(parts)), size)
    cols = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)
    out[rows, cols] = codes
    out[:, REACH] = whole
    return out, np.array(owner, np.int64)


def subsequences(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the places of its gapped three-letter subsequences and of the whole word (0: none), and the weight of each column."""
    whole, m = m[:, REACH:], m[:, :REACH]
    ids = [np.where(whole > 0, np.maximum((whole >> np.uint32(11)).astype(np.int32), 1), 0)]
    weights = [np.full(1, WHOLE, np.float32)]
    first, second, third = m * np.uint32(0x9E3779B1), m * np.uint32(0x85EBCA77), m * np.uint32(0xC2B2AE3D)
    for i, j in _GAPS:
        x = first[:, : REACH - j] + second[:, i : REACH - j + i] + third[:, j:]
        x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        place = (x >> np.uint32(11)).astype(np.int32)
        ids.append(np.where(m[:, j:] > 0, np.maximum(place, 1), 0))
        weights.append(np.full(REACH - j, DECAY ** (j - 2), np.float32))
    return np.hstack(ids), np.concatenate(weights)


def norms(ids: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Lengths of the rows' feature vectors; a subsequence that occurs twice adds up before it is squared."""
    order = np.argsort(ids, axis=1, kind="stable")
    s = np.take_along_axis(ids, order, 1)
    w = np.where(s > 0, weights[order], 0).astype(np.float64)
    total = np.cumsum(w, axis=1)
    last = np.ones(s.shape, bool)
    last[:, :-1] = s[:, 1:] != s[:, :-1]
    out = np.zeros(len(s))
    rows, cols = np.nonzero(last & (s > 0))
    upto = total[rows, cols]
    first = np.r_[True, rows[1:] != rows[:-1]] if len(rows) else np.zeros(0, bool)
    before = np.where(first, 0, np.r_[0, upto[:-1]]) if len(rows) else upto
    # Columns without a subsequence have number 0, sort first and weigh nothing.
    np.add.at(out, rows, (upto - before) ** 2)
    return np.sqrt(np.maximum(out, 1e-12))


def _newton_svm(z: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 0.02) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine in the primal, by Newton steps on the rows short of the margin that each asks for.

    The sign of y is a row's class, its size the margin.
    """
    x = np.c_[z, np.ones(len(z))]
    reg = ridge * np.eye(x.shape[1])
    reg[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(30):
        inside = np.sign(y) * (x @ w) < np.abs(y)
        xi = x[inside] * cost[inside, None]
        new = np.linalg.solve(reg + xi.T @ x[inside], xi.T @ y[inside])
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w[:-1], float(w[-1])


def _compact(ids: np.ndarray) -> np.ndarray:
    """The same places numbered without holes, 0 kept, so that a row's dense vector is short."""
    kept, at = np.unique(ids, return_inverse=True)
    at = at.reshape(ids.shape).astype(np.int32)
    return at if len(kept) and kept[0] == 0 else at + 1


def _spread(ids: np.ndarray, weights: np.ndarray, norm: np.ndarray, n: int) -> list[int]:
    """n rows, each the farthest in kernel distance from those before it."""
    ids = _compact(ids)
    near, chosen, nxt = np.full(len(ids), -1.0), [], 0
    for _ in range(min(n, len(ids))):
        chosen.append(nxt)
        near = np.maximum(near, _against(ids, weights, norm, [nxt])[:, 0])
        nxt = int(np.argmin(near))
        if near[nxt] > 0.999:
            break
    return chosen


def _against(ids: np.ndarray, weights: np.ndarray, norm: np.ndarray, landmarks: list[int]) -> np.ndarray:
    """The kernel of all rows with the landmarks; places must be numbered without holes."""
    out = np.empty((len(ids), len(landmarks)))
    for k, j in enumerate(landmarks):
        v = np.zeros(int(ids.max()) + 1, np.float32)
        np.add.at(v, ids[j], weights)
        v[0] = 0
        out[:, k] = (v[ids] @ weights) / (norm * norm[j])
    return out


def evidence(sents: list[list[float]], bias: float) -> tuple[float, float, float]:
    """What the margins of a text's words say, by sentences: the worst word of all, how many words lie beyond the plane
    between the classes (each counts by its margin, up to 1), and how many of them a sentence has."""
    beyond = sum(min(m, 1.0) for s in sents for m in s if m > 0)
    return min(max(max(map(max, sents), default=bias), -1.0), FIRM), float(np.log1p(beyond)), min(1.0, beyond / max(1, len(sents))) ** 0.5


@dataclass
class Model:
    """The folded machine: a weight for each subsequence and the bias; and the scale from a text's evidence to a probability."""

    keys: np.ndarray
    values: np.ndarray
    bias: float
    scale: np.ndarray

    def margins(self, words: list[str]) -> np.ndarray:
        """Margins of words; a word with nothing in common with the landmarks, or only with clean ones, has the bias."""
        out = np.full(len(words), self.bias)
        v = np.zeros(BUCKETS, np.float32)
        v[self.keys] = self.values
        for at in range(0, len(words), WORDS_AT_ONCE):
            m, owner = letters(words[at : at + WORDS_AT_ONCE])
            ids, weights = subsequences(m)
            dot = v[ids] @ weights
            hit = np.nonzero(dot > 0)[0]
            if len(hit):
                np.maximum.at(out, owner[hit] + at, self.bias + dot[hit] / norms(ids[hit], weights))
        return out

    def probability(self, said: np.ndarray) -> np.ndarray:
        """Probabilities of rows of evidence."""
        return 1 / (1 + np.exp(-np.clip(said @ self.scale[:-1] + self.scale[-1], -30, 30)))


class Sample:
    """The sentences of texts as numbers of their distinct words, four bytes a word; lists of words are made a text at a time."""

    def __init__(self, texts: Iterable[str]):
        number: dict[str, int] = {}
        flat, ends, upto = array("i"), array("q", [0]), array("q", [0])
        for t in texts:
            for s in sentences(t):
                flat.extend([number.setdefault(w, len(number)) for w in s])
                ends.append(len(flat))
            upto.append(len(ends) - 1)
        self.words = list(number)
        self.flat, self.ends, self.upto = np.frombuffer(flat, np.int32), np.frombuffer(ends, np.int64), np.frombuffer(upto, np.int64)

    def bag(self, i: int) -> np.ndarray:
        """The numbers of all words of text i."""
        return self.flat[self.ends[self.upto[i]] : self.ends[self.upto[i + 1]]]

    def sentences(self, i: int) -> list[list[str]]:
        """sentences() of text i."""
        cuts = self.ends[self.upto[i] : self.upto[i + 1] + 1].tolist()
        return [self.named(self.flat[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]

    def named(self, numbers: np.ndarray) -> list[str]:
        return [self.words[k] for k in numbers.tolist()]

    def contexts(self, texts: np.ndarray) -> np.ndarray:
        """For each word, how many different pairs of neighbours it has in these texts."""
        bags = [self.bag(i) for i in texts]
        w = np.zeros(sum(map(len, bags)) + len(bags) + 1, np.int32)  # 0 stands before, between and after texts
        at = 1
        for b in bags:
            w[at : at + len(b)] = b + 1
            at += len(b) + 1
        out = np.zeros(len(self.words) + 1, np.int64)
        parts = len(w) // CONTEXTS_AT_ONCE + 1
        for part in range(parts):
            # All contexts of a word are in one part.
            mid = np.nonzero(w[1:-1] % parts == part)[0] + 1
            before, word, after = (w[mid + d].astype(np.uint64) for d in (-1, 0, 1))
            with np.errstate(over="ignore"):
                key = (before * np.uint64(0x9E3779B97F4A7C15) + word) * np.uint64(0xBF58476D1CE4E5B9) + after
            _, first = np.unique(key, return_index=True)
            out += np.bincount(w[mid[first]], minlength=len(out))
        return out[1:]


@dataclass
class Words:
    """Distinct words of the sample, their odds to stand in a toxic text as a multiple of all words', and who is a witness."""

    words: list[str]
    odds: np.ndarray
    witness: np.ndarray
    in_clean: np.ndarray

    def witnesses(self) -> set[str]:
        return {w for w, k in zip(self.words, self.witness, strict=True) if k}


def _words(sample: Sample, texts: np.ndarray, toxic: np.ndarray) -> Words:
    """Of these texts of the sample. Counts are of contexts, not of texts: copies repeat them.

    A word with k of its n contexts in toxic texts is a witness if its odds are ODDS times those of all words, and if k
    or more would come by chance, bounded by Chernoff, so rarely that all words together would give CHANCE witnesses.
    Only words of so many contexts that they could pass are counted among them (Tarone's correction).
    """
    k, clean = (sample.contexts(texts[toxic[texts] == side]) for side in (True, False))
    seen = np.nonzero(k + clean)[0]
    k, clean = k[seen], clean[seen]
    n = k + clean
    share = min(max(k.sum() / max(1, n.sum()), 1e-6), 0.999)
    odds = (k + 0.5) * (1 - share) / ((n - k + 0.5) * share)
    f = k / np.maximum(n, 1)
    gain = n * (f * np.log(np.maximum(f, 1e-300) / share) + (1 - f) * np.log(np.maximum(1 - f, 1e-300) / (1 - share)))
    tested, need = len(n), np.inf
    for _ in range(20):
        need = np.log((tested + 1) / CHANCE)
        tested = int((n * -np.log(share) >= need).sum())
    return Words(sample.named(seen), odds, (f > share) & (k > 1) & (odds >= ODDS) & (gain >= need), clean)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Platt's scale with his smoothed targets, for several inputs none of which may speak for the clean class."""
    pos, neg = y.sum(), (1 - y).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a = np.c_[x, np.ones(len(x))]
    used = np.ones(a.shape[1], bool)
    while True:
        w = np.zeros(int(used.sum()))
        for _ in range(80):
            p = 1 / (1 + np.exp(-np.clip(a[:, used] @ w, -30, 30)))
            ridge = RIDGE * np.diag(np.r_[np.ones(len(w) - 1), 1e-3])
            step = np.linalg.solve((a[:, used] * (p * (1 - p))[:, None]).T @ a[:, used] + ridge, a[:, used].T @ (t - p) - ridge @ w)
            w = w + np.clip(step, -2, 2)
        if (w[:-1] >= 0).all():
            out = np.zeros(a.shape[1])
            out[used] = w
            return out
        used[np.nonzero(used)[0][int(np.argmin(w[:-1]))]] = False


def _altered(word: str, spare: str, rng: np.random.Generator) -> list[str]:
    """The word with a letter doubled, and twice with a letter of clean words put in: virtual witnesses."""
    if len(word) < 4:
        return []
    i, j, k = (int(x) for x in rng.integers(1, len(word), 3))
    a, b = (spare[int(x)] for x in rng.integers(0, len(spare), 2))
    return [word[:i] + word[i - 1] + word[i:], word[:j] + a + word[j:], word[:k] + b + word[k:]]


def _machine(sample: Sample, toxic: np.ndarray, known: Words, stems: set[str], rounds: int, seed: int) -> Model | None:
    """The machine for words, with these witnesses, these toxic texts of the sample and the counts of the words; None where there is none, or the texts give no ordinary word."""
    # A word that a clean text holds only now and then, by a quotation or a wrong label, is not clean for that.
    ordinary = {w: float(c) for w, c, o in zip(known.words, known.in_clean, known.odds, strict=True) if c and o < ODDS / 2 and w not in stems}
    suspect = {w for w, o in zip(known.words, known.odds, strict=True) if o >= ODDS / 2}
    if not stems or not ordinary:
        return None
    rng = np.random.default_rng(seed)
    pool = sorted(ordinary)
    negatives, hard = rng.choice(pool, min(len(pool), MAX_NEGATIVES // 2), replace=False).tolist(), []
    positives, model, spare = set(stems), None, "".join(c for w in pool[: MAX_NEGATIVES] for c in w if c.isalpha()) or "x"
    vocabulary = sorted({*ordinary, *(w for i in toxic for w in sample.named(np.unique(sample.bag(i))))})
    odds = dict(zip(known.words, np.clip(np.log(known.odds) / np.log(ODDS), 1.0, FIRM).tolist(), strict=True))
    for r in range(rounds):
        found = sorted(positives)
        found += [v for w in found for v in _altered(w, spare, rng) if v not in positives and v not in ordinary]
        words = found + hard + sorted(set(negatives) - set(hard))
        m, owner = letters(words)
        ids, weights = subsequences(m)
        used = np.nonzero(ids.any(axis=1))[0]
        ids, label = ids[used], np.array([odds.get(words[i], 1.0) if i < len(positives) else 0.7 if i < len(found) else -1.0 for i in owner[used]])
        near = (owner[used] >= len(found)) & (owner[used] < len(found) + len(hard))
        norm = norms(ids, weights)
        p, h, n = np.nonzero(label > 0)[0], np.nonzero(near)[0], np.nonzero((label < 0) & ~near)[0]
        # Landmarks: a half from the witnesses, and from the clean words the worst ones and some far from each other.
        groups = ((p, LANDMARKS // 2), (h, LANDMARKS // 8), (n, LANDMARKS // 8))
        marks = sorted({*h[: LANDMARKS // 4].tolist(), *(int(g[k]) for g, size in groups if len(g) for k in _spread(ids[g], weights, norm[g], size))})
        k = _against(_compact(ids), weights, norm, marks)
        value, vector = np.linalg.eigh(k[marks])
        root = vector / np.sqrt(np.maximum(value, 1e-3)) @ vector.T
        # Clean words that resemble witnesses weigh HARD times as much as all other clean ones, each by how often it occurs.
        often = np.array([ordinary.get(words[i], 1.0) for i in owner[used]])
        cost = np.where(label > 0, 1 / len(p), np.where(near, HARD * often / max(1, often[h].sum()), 1 / max(1, len(n)))) * len(label) / 2
        w, bias = _newton_svm(k @ root, label, cost)
        beta = root @ w / norm[marks]
        folded = np.zeros(BUCKETS, np.float32)
        for b, j in zip(beta, marks, strict=True):
            np.add.at(folded, ids[j], (b * weights).astype(np.float32))
        folded[0] = 0
        keys = np.nonzero(folded)[0]
        model = Model(keys, folded[keys], bias, np.zeros(4))
        if r + 1 < rounds:
            margin = dict(zip(vocabulary, model.margins(vocabulary).tolist(), strict=True))
            # Clean words that look worst join the negatives; each toxic text's worst word, if beyond the margin and of high odds, is a witness.
            worse = sorted((w for w in ordinary if margin[w] > -1), key=lambda w: (-margin[w], w))[: MAX_NEGATIVES // 8]
            hard = worse + [w for w in hard if w not in set(worse)]
            bags = (set(sample.named(np.unique(sample.bag(i)))) for i in toxic)
            worst = {max(b, key=lambda w: (margin[w], w)) for b in bags if b and not stems & b}
            positives = stems | {w for w in worst if margin[w] > 1 and w in suspect}
    return model


def _said(model: Model, n: int, text: Callable[[int], list[list[str]]]) -> np.ndarray:
    """Rows of evidence of n texts, whose sentences text gives, each twice."""
    words = sorted({w for i in range(n) for s in text(i) for w in s})
    margin = dict(zip(words, model.margins(words).tolist(), strict=True))
    return np.array([evidence([[margin[w] for w in s] for s in text(i)], model.bias) for i in range(n)])


def train(rows: Iterable[tuple[str, int]], rounds: int = 3, folds: int = 3, seed: int = 7) -> Model:
    """Fit on (text, toxic) rows; the scale is fitted on evidence that each part of the texts gets from a machine of the others.

    Only the list of witnesses, whose test allows for chance, is of all texts.

    Without both labels the score is the smoothed share of toxic rows.
    """
    rows = [((t or ""), int(y)) for t, y in rows]
    y = np.array([k for _, k in rows], np.float64)
    share = (y.sum() + 1) / (len(y) + 2)
    # Equal texts stay in one part.
    part = np.array([zlib.crc32(t.encode("utf-8", "replace")) % folds for t, _ in rows], np.int64)
    sample = Sample(t for t, _ in rows)
    # The driver holds the sample's numbers from here, not its texts.
    del rows
    every = np.arange(len(y))
    known = _words(sample, every, y > 0)
    stems = known.witnesses()
    model = _machine(sample, np.nonzero(y)[0], known, stems, rounds, seed)
    if model is None:
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0, np.array([0, 0, 0, np.log(share / (1 - share))]))
    said, held = [], []
    for f in range(folds):
        out, rest = np.nonzero(part == f)[0], np.nonzero(part != f)[0]
        other = _machine(sample, rest[y[rest] > 0], _words(sample, rest, y > 0), stems, rounds, seed)
        if other is not None and len(out):
            said.append(_said(other, len(out), lambda i, out=out: sample.sentences(out[i])))
            held.append(y[out])
    if not said:
        said, held = [_said(model, len(y), sample.sentences)], [y]
    model.scale = _logistic(np.concatenate(said), np.concatenate(held))
    return model


def probabilities(model: Model, texts: list[str]) -> list[float]:
    """Scores of whole texts."""
    return model.probability(_said(model, len(texts), lambda i: sentences(texts[i]))).tolist()


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    """Train on at most max_toxic and max_clean labelled texts, those whose hashed id is smallest, none with crc32(id) mod 3 = 1.

    Labels null in either column and labels without a text are not used; of several labels of an id, the largest holds.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).where(bucket(F.col("doc_id"), 3) != 1).groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    pick = lambda flag, n: known.where(F.col("_toxic") == flag).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = pick(1, max_toxic).union(pick(0, max_clean))
    rows = docs.select("doc_id", F.col(text).alias("_text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "_text", "_toxic")

    def unique() -> list[tuple[str, int]]:
        found = {r["doc_id"]: r for r in sorted(rows.collect(), key=lambda r: (r["doc_id"], r["_text"] or ""))}
        return [(r["_text"], r["_toxic"]) for r in found.values()]

    model = train(unique())
    # The driver lives on.
    give_back()
    return model


def worst_sentence(text: str, word: str) -> str:
    """The first sentence that holds the word."""
    return next((s for s in _SENTENCE.split(text) if word in tokens(s)), "")


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with `toxicity`: struct of score (0 to 1), worst word and the first sentence that holds it.

    Null and empty texts get the score of a text without any word in common with the landmarks. Only the text is read:
    repeated texts score alike. Long texts are read whole, one batch each; of words that are equally bad the first is
    named. A column already named toxicity is replaced; an empty table stays empty.
    """
    kind = T.StructType([T.StructField("score", T.DoubleType(), False), T.StructField("word", T.StringType(), False), T.StructField("sentence", T.StringType(), False)])
    schema = T.StructType([f for f in docs.schema if f.name != "toxicity"] + [T.StructField("toxicity", kind, False)])
    keep = [f.name for f in schema][:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[str, float] = {}
        for whole in batches:
            at = whole.schema.get_field_index(text)
            for b in _pieces(whole, at, PIECE_CHARS):
                texts = [t or "" for t in b.column(at).to_pylist()]
                bags = [sentences(t) for t in texts]
                new = {w for ss in bags for ws in ss for w in ws if w not in table}
                if len(table) + len(new) > TABLE_ENTRIES:
                    table.clear()
                    new = {w for ss in bags for ws in ss for w in ws}
                new = list(new)
                table.update(zip(new, model.margins(new).tolist(), strict=True))
                said, word, sentence = [], [], []
                for t, ss in zip(texts, bags, strict=True):
                    margins = [[table[w] for w in ws] for ws in ss]
                    top = max(map(max, margins), default=model.bias)
                    found = next((w for ws in ss for w in ws if table[w] == top), "") if top > model.bias else ""
                    said.append(evidence(margins, model.bias))
                    word.append(found)
                    sentence.append(worst_sentence(t, found) if found and model.probability(np.array(said[-1])) >= THRESHOLD else "")
                out = pa.StructArray.from_arrays([pa.array(model.probability(np.array(said).reshape(-1, 3))), pa.array(word, pa.string()), pa.array(sentence, pa.string())], ["score", "word", "sentence"])
                yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(k)) for k in keep], out], names=[*keep, "toxicity"])

    return docs.mapInArrow(lean(run), schema)
