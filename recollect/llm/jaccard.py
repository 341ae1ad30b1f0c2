"""N-gram Jaccard join by parity sketches.

A document's set are its distinct 4-word shingles. The hash of a shingle picks
one word of the document's sketch and is XOR-ed into it, so a shingle in both
of two sets cancels out of their difference, and the sketches differ in at
most as many words as the sets differ in shingles. If J(A, B) >= t, that
symmetric difference is at most d = (1-t)/(1+t) * (|A|+|B|); a sketch of more
than d words then has words in which A and B agree. So documents of a size
band are joined on (band, position, word): no similar pair is missed.

* Bands grow by half. A document that is small for the next band's partners,
  but not too small, is sketched for that band as well.
* Words without shingles say nothing. A sketch has more than d+1 words, so that
  documents with few empty ones need not be joined on these; a document with
  too many is joined on all its words, empty ones too.
* Equal sets are one node. Of the nodes that share a word, each is compared
  with the least one. Copies of one text, however many, are linked by that
  alone; only where a group still holds several components, its nodes of
  different components are compared with each other. Groups of the same nodes
  count once. Very large groups are dealt into blocks, and each two blocks are
  compared in a task of their own.
* A pair is compared first by parity bits, one for each shingle: the number of
  bits that differ is no greater than the symmetric difference. Only pairs
  within d of each other have their whole sets fetched and verified:
  100 * |A & B| >= 85 * |A | B|.

Components of the links between nodes, and the documents of each node, give
the classes.

Cases: null, empty and wordless texts have an empty set and are linked with
nothing; a text of fewer than four words has its whole sequence as its one
shingle; repeated rows are equal sets; a null id never is a component's id if
the component has another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.llm import tokens
from recollect.llm.common import annotate, discard, mapped, parallelism, release, stored, table
from recollect.llm.graph import components

SHINGLE = 4
PERCENT = 85
CHUNK = 4 << 20
#: Most nodes whose ids are broadcast to find their texts: about 8 MB.
BROADCAST_NODES = 250_000
_U = np.uint64


def bands(percent: int, upto: int) -> np.ndarray:
    """Least sizes of the bands: 1, 2, 3, 5, 8, 12, 18 ..., wider apart than similar sizes can be."""
    step = max(1.5, 100 / percent)
    out = [1]
    while out[-1] <= upto:
        out.append(int(np.ceil(out[-1] * step)))
    return np.array(out)


def difference(percent: int, sizes: int) -> int:
    """Greatest symmetric difference of similar sets whose sizes add up to ``sizes``."""
    return (100 - percent) * sizes // (100 + percent)


def words_of_band(percent: int, low: int, high: int) -> tuple[int, int]:
    """Greatest difference d in the band of sizes up to ``high - 1``, and its sketches' number of words."""
    d = difference(percent, 2 * (high - 1))
    return d, d + 1 + (d + 1 + 7) // 8 if d else 1


class Sets:
    """Shingle sets of a run of texts: text i has the sorted hashes ``items[at[i]:at[i+1]]``."""

    def __init__(self, column: pa.Array, shingle: int):
        t = tokens.tokenise(column, tokens.WHITESPACE_WORDS)
        h, at = tokens.sequence_hashes(t.hashes, t.first, shingle)
        doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
        order = np.argsort(h, kind="stable")
        order = order[np.argsort(doc[order], kind="stable")]
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        self.items = h[new]
        self.n = np.bincount(doc[new], minlength=len(at) - 1) if len(h) else np.zeros(len(at) - 1, np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.n)])
        run = np.concatenate([np.zeros(1, _U), np.cumsum(tokens.mix(self.items), dtype=_U)])
        total = run[self.at[1:]] - run[self.at[:-1]]
        #: Equal for equal sets; 0 for the empty set.
        self.node = np.where(self.n > 0, tokens.mix(total + self.n.astype(_U) * _U(0x9E3779B97F4A7C15)) | _U(1), _U(0)).view(np.int64)


def sketch_keys(s, chosen: np.ndarray, percent: int, level: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of the chosen texts' sketches, and the text of each. ``level``: how many words a pair must share.

    The last 7 bits of a key are its band.
    """
    keys, owners = [], []
    n = s.n[chosen]
    edges = bands(percent, int(n.max(initial=1)) * 2)
    own = np.searchsorted(edges, n, "right") - 1
    for band in range(len(edges) - 1):
        low, high = int(edges[band]), int(edges[band + 1])
        here = chosen[(own == band) | ((own == band - 1) & (100 * n >= percent * low))]
        if not len(here):
            continue
        d, words = words_of_band(percent, low, high)
        size = s.n[here]
        begin = np.concatenate([[0], np.cumsum(size)])
        items = s.items[np.arange(begin[-1]) - np.repeat(begin[:-1] - s.at[here], size)]
        # the word rises with the hash, and hashes are sorted within a text: no other order is needed
        word = ((items >> _U(32)) * _U(words) >> _U(32)).astype(np.int64)
        slot = np.repeat(np.arange(len(here)), size) * words + word
        first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        value, slot = np.bitwise_xor.reduceat(items, first), slot[first]
        filled = np.bincount(slot // words, minlength=len(here))
        if (poor := np.flatnonzero(words - filled > words - d - level)).size and words > 1:
            every = (poor[:, None] * words + np.arange(words)).ravel()
            empty = np.setdiff1d(every, slot)
            slot, value = np.concatenate([slot, empty]), np.concatenate([value, np.zeros(len(empty), _U)])
        salt = tokens.mix((slot % words).astype(_U) * _U(1 << 20) + _U(band))
        keys.append((tokens.mix(value ^ salt) & ~_U(127)) | _U(band))
        owners.append(here[slot // words])
    none = np.empty(0, np.int64)
    return np.concatenate([none.view(_U), *keys]), np.concatenate([none, *owners])


def parities(s: Sets) -> list[bytes]:
    """Parity bits of each text's shingles: at least as many bits as shingles, a power of two and 64 or more."""
    bits = np.maximum(64, 2 ** np.ceil(np.log2(np.maximum(s.n, 1))).astype(np.int64))
    base = np.concatenate([[0], np.cumsum(bits)])
    doc = np.repeat(np.arange(len(s.n)), s.n)
    odd = np.bincount(base[doc] + (s.items & (bits[doc] - 1).astype(_U)).astype(np.int64), minlength=base[-1]) & 1
    packed = np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()
    return [packed[i // 8 : j // 8] if n else b"" for i, j, n in zip(base[:-1], base[1:], s.n, strict=True)]


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Parity bits as those of fewer bits: a shingle's place is its hash modulo their number."""
    return np.bitwise_xor.reduce(bits.reshape(-1, words), axis=0)


def within(a: np.ndarray, b: np.ndarray, sizes: int, percent: int) -> bool:
    words = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, words) ^ folded(b, words)).sum()) <= difference(percent, sizes)


def shingle_sets(docs: DataFrame, text_col: str, shingle: int, keep: list[str], parity: bool = False) -> DataFrame:
    """``keep`` with n_shingles, node and, if asked for, parity."""

    def make():
        def run(batch: pa.RecordBatch) -> list:
            s = Sets(batch.column(text_col), shingle)
            return [s.n, s.node, *([parities(s)] if parity else [])]

        return run

    return annotate(docs, text_col, [("n_shingles", T.LongType()), ("node", T.LongType()), *([("parity", T.BinaryType())] if parity else [])], make, keep)


def _groups(docs: DataFrame, text_col: str, shingle: int, percent: int) -> DataFrame:
    """``same, node, least, many``: nodes that share a sketch word with others, with the least node of theirs and their number. Groups of the same nodes have the same ``same``; one of them is given, and by each part that has one."""
    parts = parallelism(docs.sparkSession)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tokens.chunks(batches, text_col, CHUNK):
            s = Sets(batch.column(text_col), shingle)
            _, chosen = np.unique(s.node, return_index=True)
            keys, owner = sketch_keys(s, chosen[s.n[chosen] > 0], percent)
            part = ((keys >> _U(7)) % _U(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[order], np.arange(parts + 1))
            keys, nodes = keys[order], s.node[owner[order]]
            some = np.flatnonzero(np.diff(cut))
            for p in np.array_split(some, max(1, len(some) // 64)):
                yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array([keys[cut[i] : cut[i + 1]].tobytes() for i in p], pa.binary()), pa.array([nodes[cut[i] : cut[i + 1]].tobytes() for i in p], pa.binary())], names=["part", "keys", "nodes"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_part(batches):
            keys = np.concatenate([np.frombuffer(x, np.int64) for x in part["keys"]])
            nodes = np.concatenate([np.frombuffer(x, np.int64) for x in part["nodes"]])
            part.clear()
            order = np.lexsort((nodes, keys))
            keys, nodes = keys[order], nodes[order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
            keys, nodes = keys[new], nodes[new]
            del order, new
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, int)
            n = np.diff(np.concatenate([first, [len(keys)]]))
            least, n = np.repeat(nodes[first], n), np.repeat(n, n)
            run = np.concatenate([np.zeros(1, _U), np.cumsum(tokens.mix(nodes.view(_U)), dtype=_U)])
            end = np.concatenate([first[1:], [len(keys)]]) if len(keys) else first
            same = tokens.mix(run[end] - run[first])
            _, once = np.unique(same, return_index=True)
            chosen = np.zeros(len(first), bool)
            chosen[once] = True
            many = end - first
            same, nodes, least, n = (x[(n > 1) & np.repeat(chosen, many)] for x in (np.repeat(same.view(np.int64), many), nodes, least, n))
            for i in range(0, len(nodes), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)]) for x in (same, nodes, least, n)], names=["same", "node", "least", "many"])

    sent = mapped(docs.select(text_col), sketch, "part int, keys binary, nodes binary")
    return mapped(sent.repartition(parts, "part").sortWithinPartitions("part"), meet, "same long, node long, least long, many long")


def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """Rows of a partition that is sorted by ``part``, gathered for each part."""
    held: dict[str, list] = {}
    at = None
    for batch in batches:
        columns = {c: batch.column(c) for c in batch.schema.names}
        parts = columns.pop("part").to_numpy()
        cut = [0, *(np.flatnonzero(np.diff(parts)) + 1), len(parts)]
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            if i == j:
                continue
            if parts[i] != at:
                if held:
                    yield held
                held, at = {c: [] for c in columns}, parts[i]
            for c, x in columns.items():
                held[c] += x.slice(i, j - i).to_pylist()
    if held:
        yield held


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` of nodes whose sets are similar. ``sets`` has ``node`` and ``items``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                if len(p) > len(q):
                    p, q = q, p
                if 100 * len(p) < percent * len(q):
                    keep.append(False)
                    continue
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                common = int((q[at] == p).sum())
                keep.append(100 * common >= percent * (len(p) + len(q) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    return mapped(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y"), run, "a long, b long")


def _sets_of(docs: DataFrame, nodes: DataFrame, classes: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``node, items`` of the given nodes, from one document of each."""
    wanted = classes.join(nodes, "node").select(F.col("first").alias("first_id"), F.col("node").alias("wanted"))

    def make():
        def run(batch: pa.RecordBatch) -> list:
            s = Sets(batch.column(text_col), shingle)
            items = s.items.tobytes()
            return [s.node, [items[8 * i : 8 * j] for i, j in zip(s.at[:-1], s.at[1:], strict=True)]]

        return run

    # ids of a few documents go to all texts; more than that, and both sides are dealt by id
    small = nodes.count() <= BROADCAST_NODES
    named = docs.select(F.col(id_col), F.col(text_col)).join(F.broadcast(wanted) if small else wanted, F.col(id_col).eqNullSafe(F.col("first_id")))
    out = annotate(named, text_col, [("node", T.LongType()), ("items", T.BinaryType())], make, ["wanted"])
    # an id that is repeated with another text brings other sets along
    return out.where("node = wanted").drop("wanted").dropDuplicates(["node"])


def _plausible(pairs: DataFrame, about: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` that sizes and parity bits allow to be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            ok = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
            x, y = batch.column("x"), batch.column("y")
            for i in np.flatnonzero(ok):
                ok[i] = within(np.frombuffer(x[int(i)].as_buffer(), _U), np.frombuffer(y[int(i)].as_buffer(), _U), int(n[i] + m[i]), percent)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    x = about.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("parity").alias("x"))
    y = about.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("parity").alias("y"))
    return mapped(pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "x", "y"), run, "a long, b long")


#: Nodes of a block. A task compares two blocks of a group at most, so its work stays bounded however large the group is.
CROWD = 1024
#: Groups of a node by which a pair that several groups hold is told to be another one's: the first of them.
FIRST_GROUPS = 64
#: Candidates that a node of a group names in the first round; in each round twice as many as before.
NAMED = 4


def _compared(rows: DataFrame, percent: int, most: int) -> DataFrame:
    """``key, p, q, node, named, apart, after``: for each open node the nearest ``most`` nodes of other components that sizes and parity bits allow, after those it has named.

    ``rows`` has the nodes of blocks ``p`` and ``q`` of the groups: ``key, p, q, own, node, label, n, parity, first_keys, apart, after``. A pair
    is named only in the first of its groups, as far as ``first_keys`` tell it. A node names by distance and id, and ``apart, after`` are those of the last one it has named: -1 before the first, and null if no other is left.
    """

    def compare(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        n, label, node, own = (t.column(c).to_numpy() for c in ("n", "label", "node", "own"))
        if len(n) < 2 or label.min() == label.max():
            return
        key, p, q = (t.column(c)[0].as_py() for c in ("key", "p", "q"))
        order = np.lexsort((node, n))
        last, after = (t.column(c).fill_null(-2).to_numpy()[order] for c in ("apart", "after"))
        parity = t.column("parity")
        raw = [np.frombuffer(parity[int(i)].as_buffer(), _U) for i in order]
        words = min(map(len, raw))
        bits = np.array([folded(x, words) for x in raw]).T.copy()
        n, label, node, own = n[order], label[order], node[order], own[order]
        before: dict[int, set] = {}

        def earlier(i: int) -> set:
            if i not in before:
                before[i] = {k for k in t.column("first_keys")[int(order[i])].as_py() if k < key}
            return before[i]

        upto = np.searchsorted(n, n * 100 // percent, "right")
        found = []
        for i in np.flatnonzero(last > -2):
            others = label[i + 1 : upto[i]] != label[i]
            if p != q:
                others &= own[i + 1 : upto[i]] != own[i]
            j = np.flatnonzero(others) + i + 1
            if not len(j):
                continue
            apart = np.bitwise_count(bits[:, j] ^ bits[:, i, None]).sum(axis=0, dtype=np.int64)
            near = (apart <= (100 - percent) * (n[j] + n[i]) // (100 + percent)) & ((apart > last[i]) | ((apart == last[i]) & (node[j] > after[i])))
            if not near.any():
                continue
            j, apart = j[near], apart[near]
            best, more = [], False
            for x in np.lexsort((node[j], apart)):
                if earlier(i).isdisjoint(earlier(j[x])):
                    if more := len(best) == most:
                        break
                    best.append(x)
            if best:
                end = best[-1]
                found.append((key, p, q, node[i], node[j[best]], apart[end] if more else None, node[j[end]] if more else None))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*found, strict=True), _COMPARED.types, strict=True)], schema=_COMPARED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None
        for batch in batches:
            given = [batch.column(c).to_numpy() for c in ("key", "p", "q")]
            new = np.any([x[1:] != x[:-1] for x in given], axis=0)
            cut = [0, *(np.flatnonzero(new) + 1), batch.num_rows]
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                if i < j:
                    if (now := tuple(x[i] for x in given)) != at and held:
                        yield from compare(held)
                        held = []
                    at = now
                    held.append(batch.slice(i, j - i))
        if held:
            yield from compare(held)

    n = parallelism(rows.sparkSession)
    return mapped(rows.select("key", "p", "q", "own", "node", "label", "n", "parity", "first_keys", "apart", "after").repartition(n, "key", "p", "q").sortWithinPartitions("key", "p", "q"), run, "key long, p int, q int, node long, named array<long>, apart int, after long")


_COMPARED = pa.schema([("key", pa.int64()), ("p", pa.int32()), ("q", pa.int32()), ("node", pa.int64()), ("named", pa.list_(pa.int64())), ("apart", pa.int32()), ("after", pa.int64())])


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per document: id, n_shingles, node and component_id (the least id reachable by links)."""
    spark = docs.sparkSession
    passing: list[DataFrame] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        passing.append(stored(df, f"jaccard-{name}"))
        return passing[-1]

    members = stored(shingle_sets(docs, text_col, shingle, [id_col], parity=True), "jaccard-sets")
    classes = kept(members.where("n_shingles > 0").groupBy("node").agg(F.min(id_col).alias("first"), F.min("n_shingles").alias("n"), F.first("parity").alias("parity")), "nodes")
    found = _groups(docs, text_col, shingle, percent)
    groups = kept(found.distinct(), "groups")
    release(spark)

    def verified(pairs: DataFrame) -> DataFrame:
        sets = stored(_sets_of(docs, _ends(pairs), classes, id_col, text_col, shingle), "jaccard-items")
        links = kept(verify(pairs, sets, percent), "links")
        discard(sets)
        release(spark)
        return links

    star = groups.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    tried = kept(_plausible(star, classes, percent), "tried")
    links = verified(tried)
    labels = kept(_relabelled(classes.select("node", F.col("node").alias("label")), links), "labels")
    sides = kept(_sides(groups, labels), "sides")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    blocks = sides.select("key", "node", "own", other).select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "node")
    first_keys = F.slice(F.sort_array(F.collect_list("key")), 1, FIRST_GROUPS).alias("first_keys")
    about = kept(classes.select("node", "n", "parity").join(sides.groupBy("node").agg(first_keys), "node"), "about")
    rows = blocks.withColumns({"apart": F.lit(-1), "after": F.lit(0).cast("long")})
    most = NAMED
    while True:
        # Boruvka's way: each node names its nearest candidates in other components, until no untried one is left
        asked = kept(_compared(rows.join(labels, "node").join(about, "node"), percent, most), "asked")
        pairs = asked.select("node", F.explode("named").alias("other")).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
        named = kept(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "named")
        if not named.isEmpty():
            tried = tried.unionByName(named)
            labels = kept(_relabelled(labels, verified(named)), "labels")
        # a node that has named all its candidates has none later: components only grow
        opened = asked.where("apart is not null").select("key", "p", "q", "node", "apart", "after")
        if opened.isEmpty():
            break
        rows = blocks.join(opened.select("key", "p", "q").distinct(), ["key", "p", "q"], "left_semi").join(opened, ["key", "p", "q", "node"], "left")
        most *= 2
    labels = stored(labels, "jaccard-labels")
    for x in passing:
        discard(x)
    labelled = members.drop("parity").join(labels, "node", "left")
    least = labelled.where("n_shingles > 0").groupBy("label").agg(F.min(id_col).alias("least_id"))
    return labelled.join(least, "label", "left").select(id_col, "n_shingles", "node", F.coalesce("least_id", F.col(id_col)).alias("component_id"))


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (``node, label``) after the links: components of the labels that they join."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    joined = links.join(of("a"), "a").join(of("b"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    new = components(joined).select(F.col("node").alias("label"), F.col("label").alias("to"))
    return labels.join(new, "label", "left").select("node", F.coalesce("to", "label").alias("label"))


def _sides(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """``key, node, own, blocks`` of the groups with several components and more than a pair: their number of blocks, and the node's own."""
    sides = groups.where("many > 2").select(F.col("same").alias("key"), "node", F.ceil(F.col("many") / CROWD).cast("int").alias("blocks"))
    sides = sides.withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    mixed = sides.join(labels, "node").groupBy("key", "blocks").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    # by block as well, so that no task gets a large group as a whole
    return sides.join(mixed.select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own")), ["key", "own"])


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
