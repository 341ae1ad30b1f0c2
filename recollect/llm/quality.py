"""Quality classifier by co-training of a content view and a metadata view.

The content view sees the text alone (case, symbols, repetition, word and line
shapes, common words); the metadata view sees only what describes the document
(language, source, length). Each is a logistic model. In every round each view
scores all unlabelled documents, and hands those it is surest of, in both
classes alike, to the *other* view: how sure it must be follows from counts
over all of them. The training matrices are bounded: they have rows drawn from
the documents handed over, with less weight than true labels. A view hands
over only documents on which its own held-out errors allow trust, so that a
view that knows little teaches little.

At the end both views are calibrated on labelled documents that took no part
in training, and a last logistic function of the two calibrated logits scores
all documents.

Cases: null and empty texts are scored as texts without words; null metadata
are values of their own; without labelled documents of both classes every document
gets the labels' (smoothed) rate of good ones; repeated rows score alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.llm import tokens
from recollect.llm.common import annotate, discard, mapped, stored, table
from recollect.llm.logistic import Logistic
from recollect.llm.samples import SEED, labelled_ids

#: Most labelled documents of either class, and rows drawn from the documents that a view is handed in all rounds.
SAMPLE_ROWS = 4_000
POOL_ROWS = 6_000
ROUNDS = 5
#: Share of the unlabelled documents that a view hands over in a round, and the probability it must be sure of.
HANDED = 0.05
SURE = 0.95
THRESHOLD = 0.5
#: Bytes of text whose features are computed at a time: sums over bytes take some 60 times as much memory.
CHUNK = 1 << 20
METADATA = ("lang", "source", "n_chars")
_SLOTS = 32
#: Certainties are counted in so many buckets a unit of the logit, up to the logit _MOST.
_FINE = 32
_MOST = 40
_NEVER = (1 << 30, 0.0)
_VECTOR = T.ArrayType(T.DoubleType(), False)


def _share(hit: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])
    return (run[at[1:]] - run[at[:-1]]) / np.maximum(n, 1)


def content_features(column: pa.Array) -> np.ndarray:
    """A row for each text."""
    data, at = tokens.text_bytes(column)
    size = np.diff(at)
    t = tokens.tokenise(column, tokens.WHITESPACE_WORDS)
    n, doc = t.counts, t.doc
    length = t.ends - t.starts
    upper = (data >= 65) & (data <= 90)
    lower = (data >= 97) & (data <= 122)
    digit = (data >= 48) & (data <= 57)
    space = ~tokens.WHITESPACE_WORDS[data]
    high = data >= 128
    symbol = ~(upper | lower | digit | space | high)
    letter = upper | lower | high
    same = np.zeros(len(data), bool)
    same[1:] = (data[1:] == data[:-1]) & symbol[1:]
    first, last = t.data[t.starts], t.data[t.ends - 1]
    bare = (length == 1) & ~tokens.ALNUM_WORDS[first]
    inner = np.concatenate([[0], np.cumsum(symbol)])
    symbols_in = (inner[t.ends] - inner[t.starts]) if len(t.starts) else np.empty(0, np.int64)
    loud = symbols_in >= 2
    up = np.concatenate([[0], np.cumsum(upper)])
    shouted = (up[t.ends] - up[t.starts] >= 2) if len(t.starts) else np.empty(0, bool)
    ends_open = (last == 46) | (last == 44)
    order = np.lexsort((t.hashes, doc))
    h, d = t.hashes[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    distinct = np.bincount(d[new], minlength=len(n)) if len(h) else np.zeros(len(n))
    again = np.zeros(len(length), bool)
    again[1:] = (t.hashes[1:] == t.hashes[:-1]) & (doc[1:] == doc[:-1])
    per_word = lambda x: _share(x, t.first, n)
    per_byte = lambda x: _share(x, at, size)
    lines = _share(data == 10, at, np.ones(len(n))) + 1
    return np.column_stack([
        per_byte(upper), per_byte(digit), per_byte(space), per_byte(symbol), per_byte(high), per_byte(same), per_byte(letter),
        per_byte(data == 124), per_byte(data == 33), per_byte((data == 46) | (data == 44)),
        per_word(length), per_word(length <= 3), per_word(length >= 14), per_word(bare), per_word(loud), per_word(shouted), per_word(ends_open), per_word(again),
        distinct / np.maximum(n, 1), distinct / np.sqrt(np.maximum(n, 1)), np.log1p(n), np.log1p(n / lines), np.minimum(n, 20) / 20,
    ])


def metadata_features(batch: pa.RecordBatch, columns: tuple[str, ...]) -> np.ndarray:
    """Text columns as one-hot slots of their hashes, numbers as logarithms; nulls have a slot or flag of their own."""
    parts = []
    for c in columns:
        column = batch.column(c)
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
            data, at = tokens.text_bytes(column)
            h = tokens.Tokens(data, at[:-1], at[1:], np.arange(len(at))).hashes if len(at) > 1 else np.empty(0, np.uint64)
            slot = np.where(column.is_null().to_numpy(zero_copy_only=False), _SLOTS, (h % np.uint64(_SLOTS)).astype(np.int64))
            parts.append((slot[:, None] == np.arange(_SLOTS + 1)).astype(float))
        else:
            x = column.cast(pa.float64()).fill_null(-1.0).to_numpy(zero_copy_only=False)
            x = np.nan_to_num(x, nan=-1.0, posinf=1e300)
            y = np.log1p(np.maximum(x, 0))
            parts += [y[:, None], (y**2)[:, None], (x < 0).astype(float)[:, None]]
    return np.hstack(parts) if parts else np.zeros((batch.num_rows, 0))


@dataclass
class CoTrained:
    views: list[Logistic]
    calibrations: list[Logistic]
    combined: Logistic
    handed: list[tuple[int, int]]

    def probabilities(self, views: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        own = [c.logit(np.clip(v.logit(x), -12, 12)[:, None]) for v, c, x in zip(self.views, self.calibrations, views, strict=True)]
        return [1 / (1 + np.exp(-z)) for z in own], self.combined.probability(np.column_stack(own))


@dataclass
class Handing:
    """What a view hands over in a round: for each class, documents of buckets beyond a bucket, and a share of that bucket's own."""

    view: Logistic
    cuts: list[tuple[int, float]]
    round: int

    def taken(self, x: np.ndarray, uid: np.ndarray, sure: float) -> list[np.ndarray]:
        z, coin = self.view.logit(x), _coin(uid, 2 * self.round)
        found = [_buckets(z if c else -z, sure) for c in (0, 1)]
        return [(b > at) | ((b == at) & (coin < share)) for b, (at, share) in zip(found, self.cuts, strict=True)]


def _buckets(logit: np.ndarray, sure: float) -> np.ndarray:
    """Buckets of certainty, from 0 at the probability ``sure``; -1 below it."""
    least = np.log(sure / (1 - sure))
    z = np.clip(np.nan_to_num(logit, nan=-_MOST), -_MOST, _MOST)
    return np.where(z >= least, ((z - least) * _FINE).astype(np.int64), -1)


def _coin(uid: np.ndarray, salt: int) -> np.ndarray:
    return (tokens.mix(uid.view(np.uint64) ^ tokens.mix(np.full(1, salt + 1, np.uint64))) >> np.uint64(11)) * 2.0**-53


def _cut(counts: dict[int, int], most: int) -> tuple[tuple[int, float], int]:
    """The cut beyond which ``most`` documents lie, all if there are fewer, and how many these are."""
    above = 0
    for b in sorted(counts, reverse=True):
        if above + counts[b] > most:
            return (b, (most - above) / counts[b]), most
        above += counts[b]
    return (-1, 0.0), above


class Pool:
    """All unlabelled documents, as a stored table of ``uid``, the content view's ``features`` and the metadata view's columns."""

    def __init__(self, rows: DataFrame, columns: tuple[str, ...]):
        self.rows, self.columns, self.n = rows, columns, rows.count()
        #: For each view what it has handed over in earlier rounds.
        self.before: tuple[list[Handing], list[Handing]] = ([], [])

    def _mapped(self, start, schema: str) -> DataFrame:
        """``start()`` gives f(batch, uid, views, free) for each batch and a function for the rest; ``free[v]`` says what v has not handed over yet."""
        before, columns, sure = self.before, self.columns, self.sure

        def run(batches):
            add, end = start()
            for batch in batches:
                uid = batch.column("uid").to_numpy()
                content = np.frombuffer(b"".join(batch.column("features").to_pylist())).reshape(batch.num_rows, -1)
                views = [content, metadata_features(batch, columns)]
                free = [~np.logical_or.reduce([t for h in before[v] for t in h.taken(views[v], uid, sure)], axis=0) if before[v] else np.ones(len(uid), bool) for v in (0, 1)]
                if batch.num_rows:
                    add(uid, views, free)
            yield from end()

        return mapped(self.rows, run, schema)

    def hand(self, models: list[Logistic], trusted: list[list[bool]], handed: float, sure: float, drawn: int) -> tuple[list[list[np.ndarray]], list[list[int]]]:
        """For each view and class at most ``drawn`` rows, of the *other* view, from the documents handed over; and about how many these are."""
        self.sure = sure

        def count():
            total: dict[tuple[int, int, int], int] = {}

            def add(uid, views, free):
                for v in (0, 1):
                    z = models[v].logit(views[v])
                    for c in (0, 1):
                        if trusted[v][c]:
                            b = _buckets(z if c else -z, sure)
                            for k, n in zip(*np.unique(b[free[v] & (b >= 0)], return_counts=True), strict=True):
                                total[v, c, int(k)] = total.get((v, c, int(k)), 0) + int(n)

            def end():
                if total:
                    yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in total], pa.int32()) for i in range(3)), pa.array(total.values(), pa.int64())], names=["view", "class", "bucket", "n"])

            return add, end

        counts: list[list[dict[int, int]]] = [[{}, {}], [{}, {}]]
        for r in self._mapped(count, "view int, class int, bucket int, n long").groupBy("view", "class", "bucket").agg(F.sum("n").alias("n")).collect():
            counts[r["view"]][r["class"]][r["bucket"]] = r["n"]
        most = int(handed * self.n / 2) + 1
        found = [[_cut(counts[v][c], most) if trusted[v][c] else (_NEVER, 0) for c in (0, 1)] for v in (0, 1)]
        at = len(self.before[0])
        now = [Handing(models[v], [cut for cut, _ in found[v]], at) for v in (0, 1)]
        sizes = [[n for _, n in found[v]] for v in (0, 1)]
        # a few more than are kept, as how many coins fall below a bound varies
        bound = [[(drawn + 6 * drawn**0.5 + 20) / max(1, n) for n in sizes[v]] for v in (0, 1)]

        def draw():
            chosen: dict[tuple[int, int, int], tuple] = {}

            def add(uid, views, free):
                luck = _coin(uid, 2 * at + 1)
                for v in (0, 1):
                    for c, taken in enumerate(now[v].taken(views[v], uid, sure)):
                        for i in np.flatnonzero(taken & free[v] & (luck < bound[v][c])):
                            key, row = (v, c, int(uid[i])), (float(luck[i]), views[1 - v][i].tobytes())
                            chosen[key] = min(chosen.get(key, row), row)

            def end():
                if chosen:
                    yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in chosen], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64()))), pa.array([r[0] for r in chosen.values()]), pa.array([r[1] for r in chosen.values()], pa.binary())], names=["view", "class", "uid", "luck", "row"])

            return add, end

        got: list[list[dict[int, tuple]]] = [[{}, {}], [{}, {}]]
        for r in self._mapped(draw, "view int, class int, uid long, luck double, row binary").collect():
            of, row = got[r["view"]][r["class"]], (r["luck"], bytes(r["row"]))
            of[r["uid"]] = min(of.get(r["uid"], row), row)
        for v in (0, 1):
            self.before[v].append(now[v])
        return [[np.array([np.frombuffer(x) for _, x in sorted(got[v][c].values())[:drawn]]) for c in (0, 1)] for v in (0, 1)], sizes


def co_train(labelled: list[np.ndarray], y: np.ndarray, pool: Pool, share: np.ndarray, rows: int = POOL_ROWS, rounds: int = ROUNDS, handed: float = HANDED, sure: float = SURE) -> CoTrained:
    """``labelled`` has a matrix for each view; a third of the labels is kept for calibration. ``rows``: most rows that each view is taught by the other."""
    rng = np.random.default_rng(5)
    held = rng.permutation(len(y)) % 3 == 0
    x = [[v[~held]] for v in labelled]
    targets = [[y[~held]] for _ in labelled]
    weights = [[share[~held]] for _ in labelled]
    passed = []
    fit = lambda v: Logistic.fit(np.vstack(x[v]), np.concatenate(targets[v]), np.concatenate(weights[v]))
    models = [fit(v) for v in (0, 1)]
    for _ in range(rounds):
        # trust as far as the view's own held-out labels bear out its sureness
        trusted = []
        for v in (0, 1):
            p = models[v].probability(labelled[v][held])
            trusted.append([bool(np.mean(y[held][s] == c) >= sure) if (s := (p >= sure if c else p <= 1 - sure)).sum() >= 10 else False for c in (0, 1)])
        if not any(map(any, trusted)):
            passed.append((0, 0))
            continue
        given, sizes = pool.hand(models, trusted, handed, sure, max(1, rows // (2 * rounds)))
        for v in (0, 1):
            for c in (0, 1):
                if len(given[v][c]):
                    x[1 - v].append(given[v][c])
                    targets[1 - v].append(np.full(len(given[v][c]), float(c)))
                    weights[1 - v].append(np.full(len(given[v][c]), 0.3))
        passed.append((sum(sizes[0]), sum(sizes[1])))
        models = [fit(v) for v in (0, 1)]
    logits = [np.clip(m.logit(v[held]), -12, 12)[:, None] for m, v in zip(models, labelled, strict=True)]
    calibrations = [Logistic.fit(z, y[held], share[held]) for z in logits]
    own = np.column_stack([c.logit(z) for c, z in zip(calibrations, logits, strict=True)])
    return CoTrained(models, calibrations, Logistic.fit(own, y[held], share[held]), passed)


def unlabelled(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, columns: tuple[str, ...]) -> DataFrame:
    """``uid, features`` and ``columns`` of all documents but those of the ids; rows without id have a ``uid`` by their text."""

    def make():
        def run(batch: pa.RecordBatch) -> list:
            return [[x.tobytes() for x in content_features(batch.column(text_col))]]

        return run

    rest = docs.join(F.broadcast(ids.select(id_col)), id_col, "left_anti")
    uid = F.xxhash64(F.lit(SEED + 1), F.col(id_col), F.when(F.col(id_col).isNull(), F.col(text_col))).alias("uid")
    return annotate(rest.select(uid, *dict.fromkeys([*columns, text_col])), text_col, [("features", T.BinaryType())], make, ["uid", *columns], CHUNK)


def _views(docs: DataFrame, text_col: str, columns: tuple[str, ...], keep: list[str]) -> DataFrame:
    def make():
        def run(batch: pa.RecordBatch) -> list:
            return [content_features(batch.column(text_col)).tolist(), metadata_features(batch, columns).tolist()]

        return run

    return annotate(docs.select(*dict.fromkeys([*keep, *columns, text_col])), text_col, [("content", _VECTOR), ("metadata", _VECTOR)], make, [*keep, *columns], CHUNK).drop(*columns)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", columns: tuple[str, ...] = METADATA, rows: int = SAMPLE_ROWS, pool_rows: int = POOL_ROWS) -> CoTrained | float:
    """A model from a bounded sample of labelled documents and all others; the rate of good labels if there is one class only."""
    ids, counts = labelled_ids(docs, labels, label_col, id_col, text_col, None, rows)
    good, bad = counts.get(1, 0), sum(n for v, n in counts.items() if v != 1)
    if not good or not bad:
        return (good + 1) / (good + bad + 2)
    rows_ = sorted((r["label"], r[id_col], r["content"], r["metadata"]) for r in _views(docs.join(F.broadcast(ids), id_col), text_col, columns, [id_col, "label"]).collect())
    if len({r[0] for r in rows_}) < 2:
        return (good + 1) / (good + bad + 2)
    y = np.array([r[0] for r in rows_], float)
    views = [np.array([r[i] for r in rows_], float) for i in (2, 3)]
    share = np.where(y == 1, good / max(1, (y == 1).sum()), bad / max(1, (y == 0).sum()))
    share *= len(y) / share.sum()
    rest = stored(unlabelled(docs, ids, id_col, text_col, columns), "quality-unlabelled")
    model = co_train(views, y, Pool(rest, columns), share, pool_rows)
    discard(rest)
    return model


def score_quality(docs: DataFrame, model: CoTrained | float, text_col: str = "text", columns: tuple[str, ...] = METADATA, threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with p_content, p_metadata, quality_score and keep_document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fields = [("p_content", T.DoubleType()), ("p_metadata", T.DoubleType()), ("quality_score", T.DoubleType()), ("keep_document", T.BooleanType())]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in {n for n, _ in fields}]

    def make():
        def run(batch: pa.RecordBatch) -> list:
            if isinstance(sent.value, float):
                p = np.full(batch.num_rows, sent.value)
                return [p, p, p, p >= threshold]
            own, p = sent.value.probabilities([content_features(batch.column(text_col)), metadata_features(batch, columns)])
            return [*own, p, p >= threshold]

        return run

    out = annotate(docs, text_col, fields, make, list(dict.fromkeys([*kept, *columns])), CHUNK)
    return out.select(*kept, *(n for n, _ in fields))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model, keep=["doc_id"])
