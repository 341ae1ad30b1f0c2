"""LM scoring by a Katz back-off bigram model over the whole corpus.

    P(w | h) = d(c(h w)) * c(h w) / c(h)      if h w was seen
               alpha(h) * P(w)                if not, and h was
               P(w)                           if h was not

Counts up to 5 are discounted after Good and Turing; alpha(h) is the mass that
h's followers leave, divided by the mass that P(w) gives to words that never
followed h, so that each context's probabilities add up to one exactly. P(w)
is the same construction one order lower: discounted word counts, and what
they leave is the probability of the one event "a word never seen".

How it is spread. Texts are tokenised once into chunks with word lists of
their own. A first exchange, keyed by word, counts words and gives each its
number; a second, keyed by context, counts pairs into the model's tables; a
third brings each chunk's distinct pairs to the tables' parts, and takes back
their counts and their contexts' alpha. All tables lie in the shared folder,
one row for each part. Frequent contexts (``HOT``) are dealt by pair, and the
sums that their alphas need, a bounded number, are added up on the driver.

Cases: a null or empty text is one end token; words are compared by 64-bit
hashes; a null id is a document of the training set; without training texts
every word has probability one (log 0); repeated rows count as often as they
stand there.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from recollect.llm import tokens
from recollect.llm.common import discard, parallelism, release, stored, table
from recollect.llm.exchange import SCHEMA, batches, dealt, meet, pack, pack_doubles, pack_hashes, unpack, unpack_doubles, unpack_hashes
from recollect.llm.samples import fold

#: Greatest count that is discounted.
DISCOUNTED = 5
#: Bytes of text in a chunk.
CHUNK = 8 << 20
#: A context with more than one in HOT of all tokens is dealt by pair. At most HOT words can be that frequent.
HOT = 1024
#: Numbers of the text's begin and of words outside the training texts; words follow.
BEGIN, UNKNOWN, WORDS = 0, 1, 2
_END = np.uint64(0x5DEECE66D5DEECE7)
_PAIR, _TABLE, _CHUNK, _ANSWER = 0, 1, 0, 1


@dataclass(frozen=True)
class Discount:
    """Good-Turing factors by count (index 0 is unused), 1 for greater ones."""

    factor: np.ndarray

    def __call__(self, c: np.ndarray) -> np.ndarray:
        return np.where(c < len(self.factor), self.factor[np.minimum(c, len(self.factor) - 1)], 1.0)

    @staticmethod
    def of(counts_of_counts: np.ndarray) -> Discount:
        """``counts_of_counts[r]``: how many have count r, up to DISCOUNTED + 1. Where the estimate breaks down, fewer counts are discounted, at last only 1, by half."""
        n = np.asarray(counts_of_counts, float)
        for k in range(len(n) - 2, 0, -1):
            if (n[1 : k + 2] > 0).all() and (cut := (k + 1) * n[k + 1] / n[1]) < 1:
                r = np.arange(1, k + 1)
                d = ((r + 1) * n[2 : k + 2] / n[1 : k + 1] / r - cut) / (1 - cut)
                if ((d > 0) & (d < 1)).all():
                    return Discount(np.concatenate([[0.0], d]))
        return Discount(np.array([0.0, 0.5]))


@dataclass(frozen=True)
class Words:
    """The lowest order: P(w) by count, and the event of an unknown word."""

    tokens: int
    distinct: int
    discount: Discount
    scale: float
    unknown: float
    texts: int

    @staticmethod
    def of(total: int, distinct: int, counts_of_counts: np.ndarray, texts: int) -> Words:
        d = Discount.of(counts_of_counts)
        r = np.arange(1, len(d.factor))
        left = float((counts_of_counts[1 : len(d.factor)] * r * (1 - d.factor[1:])).sum()) / max(total, 1)
        scale = 1.0
        if left <= 0:  # no rare word: one more, unknown token
            scale = total / (total + 1)
            left = 1 - scale
        return Words(total, distinct, d, scale, left, texts)

    def probability(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.scale * self.discount(c) * c / max(self.tokens, 1), self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.tokens + self.distinct + 1))


def _part(context: np.ndarray, word: np.ndarray, hot: np.ndarray, parts: int) -> np.ndarray:
    key = context.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, context), len(hot) - 1)
        key = np.where(hot[at] == context, key + (word.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F), key)
    return (tokens.mix(key) % np.uint64(parts)).astype(np.int64)


# -- chunks ---------------------------------------------------------------------------------------------


def _chunks(docs: DataFrame, id_col: str, text_col: str, learn: Column) -> DataFrame:
    """Row for each chunk: ids, flags, and as blobs: tokens in each text, codes of the tokens, hashes of the words, their training counts."""
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("learn", T.ArrayType(T.BooleanType())), T.StructField("data", T.ArrayType(T.BinaryType()))])

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(tokens.chunks(given, "text", CHUNK)):
            t = tokens.tokenise(batch.column("text"), tokens.WHITESPACE_WORDS)
            n = t.counts + 1
            ends = np.cumsum(n) - 1
            h = np.full(int(n.sum()), _END)
            inner = np.ones(len(h), bool)
            inner[ends] = False
            h[inner] = t.hashes
            learn_ = batch.column("learn").to_numpy(zero_copy_only=False).astype(bool)
            words, code = np.unique(h, return_inverse=True)
            seen = np.bincount(code, minlength=len(words))
            order = np.argsort(-seen, kind="stable")  # frequent words get small codes, which pack well
            rank = np.empty(len(words), np.int64)
            rank[order] = np.arange(len(words))
            code, words = rank[code], words[order]
            counts = np.bincount(code[np.repeat(learn_, n)], minlength=len(words))
            data = [pack(n), pack(code), pack_hashes(words), pack(counts)]
            whole = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x).cast(pa.list_(t))
            yield pa.RecordBatch.from_arrays([pa.array([(TaskContext.get().partitionId() << 24) + number]), whole(batch.column("id"), to_arrow_type(id_type)), whole(batch.column("learn"), pa.bool_()), pa.array([data], pa.list_(pa.binary()))], names=["chunk", "ids", "learn", "data"])

    return docs.select(F.col(id_col).alias("id"), F.coalesce(learn, F.lit(True)).alias("learn"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _each(chunks: DataFrame, work, columns: tuple[str, ...] = ("chunk", "data")) -> DataFrame:
    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator:
            for batch in given:
                for i in range(batch.num_rows):
                    yield from work(*(batch.column(c)[i].as_py() for c in columns))

        yield from batches(rows())

    return chunks.select(*columns).mapInArrow(run, SCHEMA)


# -- words ----------------------------------------------------------------------------------------------


def _word_parts(words: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    return dealt(((words >> np.uint64(8)) % np.uint64(parts)).astype(np.int64), parts)


def _send_words(parts: int):
    def work(chunk: int, data: list[bytes]) -> Iterable:
        words, counts = unpack_hashes(data[2]), unpack(data[3])
        order, cut = _word_parts(words, parts)
        for p in np.flatnonzero(np.diff(cut)):
            at = order[cut[p] : cut[p + 1]]
            yield int(p), 0, chunk, [pack_hashes(words[at]), pack(counts[at])]

    return work


def _count_words(parts: int):
    """Answers go to the chunks; the table's row has the words with their counts and sums over them."""

    def work(part: int, rows: list) -> Iterable:
        hashes = [unpack_hashes(data[0]) for _, _, data in rows]
        words, index = np.unique(np.concatenate(hashes), return_inverse=True)
        counts = np.bincount(index, np.concatenate([unpack(data[1]) for _, _, data in rows]).astype(float), minlength=len(words)).astype(np.int64)
        known = counts > 0
        number = np.where(known, WORDS + (np.cumsum(known) - 1) * parts + part, UNKNOWN)
        at = 0
        for (_, chunk, _), h in zip(rows, hashes, strict=True):
            i = index[at : at + len(h)]
            at += len(h)
            yield chunk, _ANSWER, part, [pack(number[i]), pack(counts[i])]
        top = np.argsort(-counts, kind="stable")[:HOT]
        own = counts[known]
        yield part, 2, part, [pack(np.array([own.sum(), len(own), counts[words == _END].sum()])), pack(np.bincount(np.minimum(own, DISCOUNTED + 2), minlength=DISCOUNTED + 3)), pack(number[top]), pack(counts[top]), pack_hashes(words[known]), pack(own)]

    return work


def _numbered(parts: int):
    """A chunk with the answers to its words: numbers and counts take the place of hashes."""

    def work(chunk: int, rows: list) -> Iterable:
        data = rows[0][2]
        words = unpack_hashes(data[2])
        order, cut = _word_parts(words, parts)
        number, count = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        for _, part, answer in rows[1:]:
            at = order[cut[part] : cut[part + 1]]
            number[at], count[at] = unpack(answer[0]), unpack(answer[1])
        yield chunk, _CHUNK, chunk, [data[0], data[1], pack(number), pack(count), data[4]]

    return work


# -- pairs ----------------------------------------------------------------------------------------------


def _pairs(data: list[bytes], learned_only: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's distinct pairs, as codes of context (0: begin) and word, in order of their numbers; how often each occurs, and the pair of each token."""
    n, code, number = unpack(data[0]), unpack(data[1]), unpack(data[2])
    before = np.empty_like(code)
    before[1:] = code[:-1] + 1
    before[(np.cumsum(n) - n)] = 0
    rank = np.argsort(np.argsort(number, kind="stable"), kind="stable")
    context_rank = np.concatenate([[0], rank + 1])
    key = context_rank[before] * np.int64(len(number)) + rank[code]
    if learned_only:
        key = key[np.repeat(np.frombuffer(data[4], bool), n)]
    keys, index, times = np.unique(key, return_inverse=True, return_counts=True)
    by_rank = np.argsort(number, kind="stable")
    context = keys // max(1, len(number))
    return np.where(context > 0, by_rank[context - 1] + 1, 0) if len(number) else context, by_rank[keys % max(1, len(number))] if len(number) else keys, times, index


def _runs(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.empty(0, np.int64)
    return first, np.diff(np.concatenate([first, [len(sorted_)]]))


def _numbers(data: list[bytes], context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    number = unpack(data[2])
    return np.concatenate([[BEGIN], number])[context], number[word]


def _send_counts(parts: int, hot: np.ndarray):
    def work(chunk: int, data: list[bytes]) -> Iterable:
        context, word, times, _ = _pairs(data, True)
        h, w = _numbers(data, context, word)
        c = unpack(data[3])[word]
        order, cut = dealt(_part(h, w, hot, parts), parts)
        for p in np.flatnonzero(np.diff(cut)):
            at = order[cut[p] : cut[p + 1]]
            first, run = _runs(h[at])
            yield int(p), _PAIR, chunk, [pack(np.diff(h[at][first], prepend=0)), pack(run), pack(w[at]), pack(times[at]), pack(c[at])]

    return work


def _count_pairs(words: Words, hot: np.ndarray):
    """The table's row: contexts, their numbers of pairs, words, counts, and for each context the mass of P(w) that its followers have."""

    def work(part: int, rows: list) -> Iterable:
        h = np.concatenate([np.repeat(np.cumsum(unpack(d[0])), unpack(d[1])) for _, _, d in rows])
        w, times, c = (np.concatenate([unpack(d[i]) for _, _, d in rows]) for i in (2, 3, 4))
        order = np.lexsort((w, h))
        h, w, times, c = h[order], w[order], times[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])]))
        times = np.add.reduceat(times, first)
        h, w, c = h[first], w[first], c[first]
        begin, run = _runs(h)
        context = h[begin]
        lower = np.add.reduceat(words.probability(c), begin)
        counted = np.bincount(np.minimum(times, DISCOUNTED + 2), minlength=DISCOUNTED + 3)
        small = [np.add.reduceat((times == r).astype(np.int64), begin) for r in range(1, DISCOUNTED + 1)]
        total = np.add.reduceat(times, begin)
        common = np.flatnonzero(np.isin(context, hot))
        sums = [pack(context[common]), pack(total[common]), pack_doubles(lower[common]), *(pack(s[common]) for s in small)]
        yield part, _PAIR, part, [pack(np.diff(context, prepend=0)), pack(run), pack(w), pack(times), pack_doubles(lower), pack(counted), *sums]

    return work


def _alpha(total: np.ndarray, small: list[np.ndarray], lower: np.ndarray, discount: Discount) -> tuple[np.ndarray, np.ndarray]:
    """Back-off weights and, for contexts whose followers leave nothing, the factor that makes room for one more token."""
    left = np.zeros(len(total))
    for r in range(1, len(discount.factor)):
        left += small[r - 1] * r * (1 - discount.factor[r])
    scale = np.where(left > 0, 1.0, total / (total + 1.0))
    left = np.where(left > 0, left / np.maximum(total, 1), 1 - scale)
    return left / np.maximum(1 - lower, 1e-12), scale


def _send_questions(parts: int, hot: np.ndarray):
    def work(chunk: int, data: list[bytes]) -> Iterable:
        context, word, _, _ = _pairs(data, False)
        h, w = _numbers(data, context, word)
        order, cut = dealt(_part(h, w, hot, parts), parts)
        for p in np.flatnonzero(np.diff(cut)):
            at = order[cut[p] : cut[p + 1]]
            first, run = _runs(h[at])
            yield int(p), _TABLE, chunk, [pack(np.diff(h[at][first], prepend=0)), pack(run), pack(w[at])]

    return work


def _answer(discount: Discount, hot: dict[int, tuple[float, float]]):
    """For each chunk: its pairs' counts, and its contexts' back-off weights and scales."""

    def work(part: int, rows: list) -> Iterable:
        have = rows[0][0] == _PAIR
        data = rows[0][2] if have else None
        context, run = (np.cumsum(unpack(data[0])), unpack(data[1])) if have else (np.empty(0, np.int64),) * 2
        word, times, lower = (unpack(data[2]), unpack(data[3]), unpack_doubles(data[4])) if have else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        begin = np.cumsum(run) - run
        if have:
            alpha, scale = _alpha(np.add.reduceat(times, begin), [np.add.reduceat((times == r).astype(np.int64), begin) for r in range(1, DISCOUNTED + 1)], lower, discount)
        else:
            alpha = scale = np.empty(0)
        for i, (a, s) in ((np.searchsorted(context, x), v) for x, v in hot.items()):
            if i < len(context) and context[i] in hot:
                alpha[i], scale[i] = a, s
        width = int(word.max(initial=0)) + 1
        key = np.repeat(np.arange(len(context)), run) * width + word
        for _, chunk, asked in rows[1:] if have else rows:
            h, n, w = np.cumsum(unpack(asked[0])), unpack(asked[1]), unpack(asked[2])
            i = np.minimum(np.searchsorted(context, h), max(0, len(context) - 1))
            known = context[i] == h if len(context) else np.zeros(len(h), bool)
            a, s = np.ones(len(h)), np.ones(len(h))
            a[known], s[known] = alpha[i[known]], scale[i[known]]
            for j in np.flatnonzero(~known):  # a frequent context none of whose pairs came to this part
                a[j], s[j] = hot.get(int(h[j]), (1.0, 1.0))
            c = np.zeros(len(w), np.int64)
            if len(key):
                want = np.where(w < width, np.repeat(i, n) * width + w, -1)
                at = np.minimum(np.searchsorted(key, want), len(key) - 1)
                same = (key[at] == want) & np.repeat(known, n)
                c[same] = times[at[same]]
            yield chunk, _ANSWER, part, [pack(c), pack_doubles(a), pack_doubles(s)]

    return work


def _scored(parts: int, hot: np.ndarray, words: Words, discount: Discount):
    def work(chunk: int, rows: list) -> Iterable:
        data = rows[0][2]
        context, word, _, index = _pairs(data, False)
        h, w = _numbers(data, context, word)
        number, count = unpack(data[2]), unpack(data[3])
        order, cut = dealt(_part(h, w, hot, parts), parts)
        c, alpha, scale = np.zeros(len(h), np.int64), np.ones(len(h)), np.ones(len(h))
        for _, part, answer in rows[1:]:
            at = order[cut[part] : cut[part + 1]]
            _, run = _runs(h[at])
            c[at] = unpack(answer[0])
            alpha[at], scale[at] = np.repeat(unpack_doubles(answer[1]), run), np.repeat(unpack_doubles(answer[2]), run)
        of_context = np.concatenate([[words.texts], count])[context]
        single = words.probability(count)
        p = np.where(c > 0, scale * discount(c) * c / np.maximum(of_context, 1), alpha * single[word])
        n, code = unpack(data[0]), unpack(data[1])
        begin = np.cumsum(n) - n
        sums = lambda x: np.add.reduceat(x, begin)
        logs = np.log10(p)[index] if words.tokens else np.zeros(len(index))
        yield chunk, [n, sums((number != UNKNOWN)[code].astype(np.int64)), sums(words.base(count)[code]), sums(logs)]

    return work


# -- the operator ---------------------------------------------------------------------------------------


def katz_scores(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its id, learned, n_tokens, n_known, train_tokens, base_score and score (log10). The model learns from rows where ``learn``."""
    spark = docs.sparkSession
    parts = parallelism(spark)
    chunks = stored(_chunks(docs, id_col, text_col, learn), "katz-chunks")
    counted = stored(meet(_each(chunks, _send_words(parts)), parts, _count_words(parts)), "katz-words")
    release(spark)
    # bounded: a few sums and at most HOT frequent words for each part
    sums = [[unpack(x) for x in r["d"]] for r in counted.where("kind = 2").select(F.slice("data", 1, 4).alias("d")).collect()]
    totals = np.sum([s[0] for s in sums], axis=0) if sums else np.zeros(3, np.int64)
    words = Words.of(int(totals[0]), int(totals[1]), np.sum([s[1] for s in sums], axis=0)[: DISCOUNTED + 2] if sums else np.zeros(DISCOUNTED + 2), int(totals[2]))
    hot = np.unique(np.concatenate([[BEGIN], *(s[2][s[3] * HOT > words.tokens] for s in sums)])).astype(np.int64)

    flags = F.transform("learn", lambda x: x.cast("int"))
    own = chunks.select(F.col("chunk").alias("part"), F.lit(_CHUNK).alias("kind"), F.col("chunk").alias("source"), F.concat("data", F.array(_bits(flags))).alias("data"))
    numbered = stored(meet(own.unionByName(counted.where(F.col("kind") == _ANSWER)), parts, _numbered(parts)), "katz-numbered")
    ids = stored(chunks.select("chunk", "ids", "learn"), "katz-ids")
    discard(chunks)
    discard(counted)
    release(spark)
    body = numbered.select(F.col("part").alias("chunk"), "data")
    model = stored(meet(_each(body, _send_counts(parts, hot)), parts, _count_pairs(words, hot)), "katz-pairs")
    release(spark)
    discount, weights = _higher_order(model, hot)
    asked = _each(body, _send_questions(parts, hot)).unionByName(model.select("part", "kind", "source", F.slice("data", 1, 5).alias("data")))
    answers = stored(meet(asked, parts, _answer(discount, weights)), "katz-answers")
    discard(model)
    release(spark)

    def rows(results: Iterable) -> Iterator[pa.RecordBatch]:
        for chunk, (n, known, base, score) in results:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), chunk)), pa.array(np.arange(len(n), dtype=np.int32)), *map(pa.array, (n, known, base, score))], names=["chunk", "pos", "n_tokens", "n_known", "base_score", "score"])

    scored = meet(numbered.unionByName(answers), parts, _scored(parts, hot, words, discount), "chunk long, pos int, n_tokens long, n_known long, base_score double, score double", rows)
    names = ids.select("chunk", F.posexplode(F.arrays_zip("ids", "learn")).alias("pos", "x")).select("chunk", "pos", F.col("x.ids").alias(id_col), F.col("x.learn").alias("learned"))
    return names.join(scored, ["chunk", "pos"]).select(id_col, "learned", "n_tokens", "n_known", F.lit(words.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def _bits(flags: Column) -> Column:
    """An array of 0 and 1 as bytes."""
    return F.unhex(F.concat_ws("", F.transform(flags, lambda x: F.when(x == 1, "01").otherwise("00"))))


def _higher_order(model: DataFrame, hot: np.ndarray) -> tuple[Discount, dict[int, tuple[float, float]]]:
    """Discounts of pairs, and (alpha, scale) of the frequent contexts, from the parts' sums."""
    rows = [r["d"] for r in model.select(F.slice("data", 6, 4 + DISCOUNTED).alias("d")).collect()]
    discount = Discount.of(np.sum([unpack(d[0]) for d in rows], axis=0)[: DISCOUNTED + 2] if rows else np.zeros(DISCOUNTED + 2))
    total, lower, small = np.zeros(len(hot), np.int64), np.zeros(len(hot)), [np.zeros(len(hot), np.int64) for _ in range(DISCOUNTED)]
    for d in rows:
        at = np.searchsorted(hot, unpack(d[1]))
        total[at] += unpack(d[2])
        lower[at] += unpack_doubles(d[3])
        for r in range(DISCOUNTED):
            small[r][at] += unpack(d[4 + r])
    alpha, scale = _alpha(total, small, lower, discount)
    return discount, {int(h): (float(a), float(s)) for h, n, a, s in zip(hot, total, alpha, scale, strict=True) if n}


def op2_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = fold("doc_id", 7) == 2
    out = katz_scores(table(spark, sf_dir, "documents"), ~held)
    return out.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
