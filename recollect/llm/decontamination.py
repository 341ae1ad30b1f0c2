"""Benchmark decontamination by a prefix-filtered join of word windows.

An item's windows are its runs of eight words (the whole item if shorter). A
window occurs in a document only if all its words do, so with containment 1.0
its necessary prefix is one word: its rarest, by counts over the whole corpus.
A document word that is some window's prefix word names a candidate start
(positional bound), the document must have room for the window there (length
bound), and the eight words are then compared, first by hash and at last byte
by byte. Documents stay where they are: the windows travel, in blocks of
bounded size, and each block's memory is freed before the next one's is read.

Cases: null or wordless texts have no words and no hits; items that are null,
wordless or without an id have no windows; repeated items and windows count
once per item_id; columns of the input that bear an output's name are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.llm import tokens
from recollect.llm.common import annotate, table

WINDOW = 8
#: Windows in a block that is sent to the executors: about 20 MB.
BLOCK_WINDOWS = 100_000
_BITS = 20
FIELDS = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items_sha256", T.StringType()), ("item_ids", T.ArrayType(T.StringType())), ("hit_spans", T.ArrayType(T.IntegerType())), ("contaminated", T.BooleanType())]


def _item_windows(rows: Iterator, window: int) -> Iterator[tuple[tuple[bytes, ...], str]]:
    for item, text in rows:
        if item is None or not text:
            continue
        t = tokens.tokenise(pa.array([text]), tokens.ALNUM_WORDS)
        words = [t.word(i) for i in range(len(t.starts))]
        for i in range(max(1, len(words) - window + 1) if words else 0):
            yield tuple(words[i : i + window]), str(item)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, size: int) -> Iterator[dict[tuple[bytes, ...], set[str]]]:
    block: dict[tuple[bytes, ...], set[str]] = {}
    rows = ((r[0], r[1]) for r in benchmark.select(id_col, text_col).toLocalIterator())
    for words, item in _item_windows(rows, window):
        if words not in block and len(block) >= size:
            yield block
            block = {}
        block.setdefault(words, set()).add(item)
    if block:
        yield block


def _hash_words(words: list[bytes]) -> np.ndarray:
    at = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    data = np.frombuffer(b"".join(words), np.uint8)
    return tokens.Tokens(data, at[:-1], at[1:], np.array([0, len(words)])).hashes


def _bitmap(keys: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << _BITS, bool)
    bits[keys & np.uint64((1 << _BITS) - 1)] = True
    return bits


def _maybe(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return np.flatnonzero(bits[hashes & np.uint64((1 << _BITS) - 1)])


def word_counts(docs: DataFrame, text_col: str, words: list[bytes]) -> dict[bytes, int]:
    """How often each of ``words`` occurs in all of ``docs``; the result is bounded by ``words``."""
    keys = _hash_words(words)
    order = np.argsort(keys)
    keys, bits = keys[order], _bitmap(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(keys), np.int64)
        for batch in tokens.chunks(batches, text_col, 4 << 20):
            h = tokens.tokenise(batch.column(text_col), tokens.ALNUM_WORDS).hashes
            h = h[_maybe(h, bits)]
            at = np.searchsorted(keys, h)
            at[at == len(keys)] = 0
            total += np.bincount(at[keys[at] == h], minlength=len(keys))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["word", "n"])

    found = docs.select(text_col).mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {words[order[r["word"]]]: r["n"] for r in found}


class _Index:
    """The windows of a block, ordered by prefix word."""

    def __init__(self, block: dict[tuple[bytes, ...], set[str]], counts: dict[bytes, int]):
        windows = list(block)
        offset = np.array([min(range(len(w)), key=lambda i: (counts.get(w[i], 0), w[i], i)) for w in windows])
        prefix = _hash_words([w[o] for w, o in zip(windows, offset, strict=True)])
        order = np.argsort(prefix, kind="stable")
        self.windows = [windows[i] for i in order]
        self.items = [sorted(block[w]) for w in self.windows]
        self.prefix, self.offset = prefix[order], offset[order]
        self.length = np.array([len(w) for w in self.windows])
        self.hashes = np.zeros((len(windows), int(self.length.max())), np.uint64)
        flat = _hash_words([x for w in self.windows for x in w])
        self.hashes[np.arange(self.hashes.shape[1]) < self.length[:, None]] = flat
        self.bits = _bitmap(self.prefix)

    def occurrences(self, t: tokens.Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, first word and window of every verified occurrence."""
        at = _maybe(t.hashes, self.bits)
        h = t.hashes[at]
        low, high = np.searchsorted(self.prefix, h), np.searchsorted(self.prefix, h, "right")
        n = high - low
        at, base = np.repeat(at, n), np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        w = base + np.arange(len(base))
        start, doc = at - self.offset[w], t.doc[at]
        fits = (start >= t.first[doc]) & (start + self.length[w] <= t.first[doc + 1])
        start, doc, w = start[fits], doc[fits], w[fits]
        for j in range(self.hashes.shape[1]):
            same = (self.length[w] <= j) | (t.hashes[np.minimum(start + j, len(t.hashes) - 1)] == self.hashes[w, j])
            start, doc, w = start[same], doc[same], w[same]
        exact = np.array([all(t.word(s + j) == x for j, x in enumerate(self.windows[i])) for s, i in zip(start, w, strict=True)], bool)
        return doc[exact], start[exact], w[exact]


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, min_items: int = 2, block_windows: int = BLOCK_WINDOWS, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256, item_ids, hit_spans (flat pairs of word positions) and contaminated."""
    spark = docs.sparkSession
    sent = []
    for block in _blocks(benchmark, item_id_col, item_text_col, window, block_windows):
        counts = word_counts(docs, text_col, sorted({x for w in block for x in w}))
        sent.append(spark.sparkContext.broadcast(_Index(block, counts)))
    return annotate(docs, text_col, FIELDS, _matcher(sent, text_col, min_items), keep)


def _matcher(sent: list, text_col: str, min_items: int) -> Callable[[], Callable]:
    def make() -> Callable:
        def read(b) -> _Index:
            return b.value if len(sent) == 1 else b.load_from_path(b._path)

        def run(batch: pa.RecordBatch) -> list:
            t = tokens.tokenise(batch.column(text_col), tokens.ALNUM_WORDS)
            n = batch.num_rows
            edge = np.zeros(len(t.starts) + 1, np.int64)
            items: dict[int, set[str]] = {}
            for b in sent:
                index = read(b)
                doc, start, w = index.occurrences(t)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + index.length[w], -1)
                for d, i in set(zip(doc.tolist(), w.tolist(), strict=True)):
                    items.setdefault(d, set()).update(index.items[i])
            hit = np.cumsum(edge)[:-1] > 0
            n_hit = np.diff(np.concatenate([[0], np.cumsum(hit)])[t.first])
            ids = [sorted(items.get(d, ())) for d in range(n)]
            spans: list[list[int]] = [[] for _ in range(n)]
            for d in items:
                own = np.concatenate([[0], hit[t.first[d] : t.first[d + 1]].view(np.int8), [0]])
                spans[d] = np.flatnonzero(np.diff(own)).tolist()
            return [t.counts.astype(np.int64), n_hit.astype(np.int64), [len(x) for x in ids], [hashlib.sha256(",".join(x).encode()).hexdigest() for x in ids], ids, spans, [len(x) >= min_items for x in ids]]

        return run

    return make


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
