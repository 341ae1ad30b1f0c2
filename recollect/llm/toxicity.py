"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated bigram models, of toxic and of ordinary labelled texts, differ
in their own counts only. Below those stands one distribution of continuations
(in how many contexts a word was seen, over both classes), so that an
expression which neither or one class has seen rarely is smoothed towards the
same value in both, and tells them apart by its discounted counts alone.

A text feeds each of its expressions to the counts once, so that neither a
line repeated in one text nor an exact copy of a text weighs more.

A text's log-likelihoods under the two are compared per word: over the whole
text by the bigram models, and over its most telling distinct words (the 1, 3
and 10 with the greatest difference, each sum divided by its length) by their
lower order, since a long text may offend in one expression, and a pair in a
rare context says little about either class. A logistic function, fitted on
labelled texts that did not feed the counts, turns these into a probability at
the labels' own rate.

Cases: null and empty texts have no evidence and get the probability that the
calibration gives to none; without labels of both classes every score is the
(smoothed) rate of toxic labels; repeated rows score alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.llm import tokens
from recollect.llm.common import annotate, table
from recollect.llm.logistic import Logistic
from recollect.llm.samples import fold, labelled_ids

#: Most labelled documents of either class that a model is fitted on.
SAMPLE_ROWS = 4_000
#: Bytes of text of the sample, as its words are counted on the driver: half for either label.
SAMPLE_BYTES = 48 << 20
THRESHOLD = 0.3
_BITS = 22
_NONE = np.uint64(0)


def _pairs(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of each word with the one before it in its text."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[first[:-1][first[:-1] < len(h)]] = _NONE
    return tokens.mix(before * np.uint64(0x9E3779B97F4A7C15) + h), before


def _counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(x, return_counts=True)


class _Map:
    """Sorted keys to rows of values, behind a bit for each key's low bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[keys & np.uint64((1 << _BITS) - 1)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``h`` that are keys, and their rows."""
        at = np.flatnonzero(self.bits[h & np.uint64((1 << _BITS) - 1)])
        if not len(at) or not len(self.keys):
            return at[:0], at[:0]
        i = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        same = self.keys[i] == h[at]
        return at[same], i[same]


def _discounts(counts: np.ndarray) -> np.ndarray:
    """Discounts of counts 1, 2 and 3 or more, from counts of counts."""
    n = np.bincount(np.minimum(counts, 5), minlength=6).astype(float)
    if min(n[1:5]) <= 0:
        return np.array([0.0, 0.75, 0.75, 0.75])
    y = n[1] / (n[1] + 2 * n[2])
    return np.clip([0.0, 1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]], 0.0, [0, 0.99, 1.9, 2.9])


@dataclass
class KneserNey:
    """Log-probabilities under both classes, by word and by pair of words."""

    words: _Map  # unigram probability under (ordinary, toxic)
    pairs: _Map  # discounted relative frequency of a pair under (ordinary, toxic)
    contexts: _Map  # weight that a context leaves to the unigram, under (ordinary, toxic)
    unseen: np.ndarray

    @staticmethod
    def fit(texts: list[tuple[np.ndarray, int]]) -> KneserNey:
        none = np.empty(0, np.uint64)
        h = [np.concatenate([none, *(np.unique(x) for x, y in texts if y == c)]) for c in (0, 1)]
        own, ends = [], []
        for c in (0, 1):
            pairs, before, last = [none], [none], [none]
            for x in (x for x, y in texts if y == c and len(x)):
                p, b = _pairs(x, np.array([0, len(x)]))
                _, at = np.unique(p, return_index=True)
                pairs, before, last = [*pairs, p[at]], [*before, b[at]], [*last, x[at]]
            own.append((np.concatenate(pairs), np.concatenate(before)))
            ends.append(np.concatenate(last))
        # continuations, over both classes: distinct contexts of each word
        both, where = np.unique(np.concatenate([p for p, _ in own]), return_index=True)
        ends = np.concatenate(ends)[where]
        words, contexts_of = _counted(ends)
        d = _discounts(contexts_of)
        total = max(1, contexts_of.sum())
        left = d[np.minimum(contexts_of, 3)].sum() / total
        vocabulary = len(words) + 1
        shared = (contexts_of - d[np.minimum(contexts_of, 3)]) / total + left / vocabulary
        unseen = np.full(2, left / vocabulary if len(words) else 1.0)
        uni, con, pair = np.zeros((len(words), 2)), [], np.zeros((len(both), 2))
        for c in (0, 1):
            w, n = _counted(h[c])
            d = _discounts(n)
            off = d[np.minimum(n, 3)]
            total = max(1, n.sum())
            back = off.sum() / total if len(n) else 1.0
            uni[:, c] = back * shared
            uni[np.searchsorted(words, w), c] += (n - off) / total
            unseen[c] *= back
            p, at, n = np.unique(own[c][0], return_index=True, return_counts=True)
            before = own[c][1][at]
            d = _discounts(n)
            off = d[np.minimum(n, 3)]
            contexts, index = np.unique(before, return_inverse=True)
            mass = np.bincount(index, n) if len(n) else np.empty(0)
            pair[np.searchsorted(both, p), c] = (n - off) / mass[index] if len(n) else 0
            con.append((contexts, np.bincount(index, off) / mass if len(n) else mass))
        contexts = np.unique(np.concatenate([x for x, _ in con]))
        rest = np.ones((len(contexts), 2))
        for c in (0, 1):
            rest[np.searchsorted(contexts, con[c][0]), c] = con[c][1]
        return KneserNey(_Map(words, uni), _Map(both, pair), _Map(contexts, rest), unseen)

    def differences(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Toxic less ordinary log-probability of each word after the one before it, and of each word alone."""
        pairs, before = _pairs(h, first)
        p = np.broadcast_to(self.unseen, (len(h), 2)).copy()
        at, i = self.words.find(h)
        p[at] = self.words.values[i]
        alone = np.log(p)
        at, i = self.contexts.find(before)
        p[at] *= self.contexts.values[i]
        at, i = self.pairs.find(pairs)
        p[at] += self.pairs.values[i]
        p = np.log(p)
        return p[:, 1] - p[:, 0], alone[:, 1] - alone[:, 0]

    def evidence(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Per text: difference per word over all of it and over its 1, 3 and 10 most telling words."""
        n = np.diff(first)
        out = np.zeros((len(n), 4))
        if not len(h):
            return out
        gain, alone = self.differences(h, first)
        run = np.concatenate([[0.0], np.cumsum(gain)])
        out[:, 0] = (run[first[1:]] - run[first[:-1]]) / np.maximum(n, 1)
        doc = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((h, -alone, doc))  # a word has one value, so its repeats stand together
        h, doc, alone = h[order], doc[order], alone[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        distinct = np.bincount(doc[new], minlength=len(n))
        begin = np.concatenate([[0], np.cumsum(distinct)])[:-1]
        top = np.concatenate([[0.0], np.cumsum(alone[new])])
        for j, k in enumerate((1, 3, 10)):
            m = np.minimum(distinct, k)
            out[:, j + 1] = (top[begin + m] - top[begin]) / np.maximum(m, 1)
        return out


@dataclass
class Toxicity:
    models: KneserNey | None
    calibration: Logistic

    def score(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        x = self.models.evidence(h, first) if self.models else np.zeros((len(first) - 1, 4))
        return self.calibration.probability(x)


def _hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    t = tokens.tokenise(column, tokens.ALNUM_WORDS)
    return t.hashes, t.first


def _word_hashes(text_col: str):
    def make():
        def run(batch: pa.RecordBatch) -> list:
            h, first = _hashes(batch.column(text_col))
            return [[h[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]]

        return run

    return make


def fit(docs: DataFrame, labels: DataFrame, where: Column | None = None, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> Toxicity:
    """Models from at most ``rows`` labelled documents of either class: two in three feed the counts, the third the calibration."""
    ids, counts = labelled_ids(docs, labels, label_col, id_col, text_col, where, rows, size)
    named = docs.select(F.col(id_col), F.col(text_col)).join(F.broadcast(ids), id_col)
    got = annotate(named, text_col, [("words", T.BinaryType())], _word_hashes(text_col), ["label", id_col])
    texts = {bytes(r["words"]): (r[id_col], r["label"]) for r in sorted(got.collect(), key=lambda r: r[id_col], reverse=True)}
    sample = sorted((i, y, w) for w, (i, y) in texts.items())
    rng = np.random.default_rng(7)
    third = rng.permutation(len(sample)) % 3 == 0
    texts = [(np.frombuffer(w, np.uint64), y) for _, y, w in sample]
    y = np.array([y for _, y in texts], float)
    positive, negative = counts.get(1, 0), sum(n for v, n in counts.items() if v != 1)
    if not 0 < y[~third].sum() < (~third).sum():
        return Toxicity(None, Logistic.fit(np.zeros((0, 4)), np.zeros(0)) if not counts else Logistic(np.zeros(4), np.ones(4), np.zeros(4), float(np.log((positive + 1) / (negative + 1)))))
    models = KneserNey.fit([t for t, held in zip(texts, third, strict=True) if not held])
    held = [t for t, x in zip(texts, third, strict=True) if x]
    first = np.concatenate([[0], np.cumsum([len(h) for h, _ in held])]).astype(np.int64)
    x = models.evidence(np.concatenate([h for h, _ in held]), first)
    share = np.where(y == 1, positive / max(1, (y == 1).sum()), negative / max(1, (y != 1).sum()))[third]
    share *= len(share) / max(share.sum(), 1e-9)
    return Toxicity(models, Logistic.fit(x, y[third], share))


def score_toxicity(docs: DataFrame, model: Toxicity, text_col: str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def run(batch: pa.RecordBatch) -> list:
            score = sent.value.score(*_hashes(batch.column(text_col)))
            return [score, (score >= threshold).astype(np.int32)]

        return run

    return annotate(docs, text_col, [("score", T.DoubleType()), ("predicted", T.IntegerType())], make, keep)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)
    out = score_toxicity(docs, model, keep=["doc_id"])
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")
