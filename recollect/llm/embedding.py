"""Embedding near-duplicates by navigable small-world graphs.

Equal vectors are one node. Nodes are dealt by hash to shards of bounded size,
each shard's graph is built by one task, and every node is searched for in
every shard: its neighbours with cosine >= 0.9, checked in double precision,
are links. Their components are the classes.

An audit then compares a bounded, seeded set of nodes with all nodes: how many
of their true links lie inside one component. While that is less than asked,
all searches are repeated with a beam twice as wide, which at last is as wide
as a shard and so exact. Links are counted at the end inside the components,
in blocks, so that a count misses nothing that a beam was too narrow for.

Cases: vectors that are null, empty, zero or hold null or non-finite numbers
link with nothing, and are components of their own; vectors of different
lengths are compared as if the shorter ended in zeros; repeated rows are equal
vectors and link with each other; labels are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import hnsw, tokens
from recollect.llm.common import parallelism, release, stored, table
from recollect.llm.exchange import SCHEMA, batches, meet
from recollect.llm.graph import components

THRESHOLD = 0.9
#: Most vectors of a shard: with graph and vectors about 50 MB at 64 numbers a vector.
SHARD_ROWS = 65_536
BEAM = 48
#: Nodes that an audit compares with all, and the share of their links that must lie inside components.
AUDITED = 512
RECALL = 0.99
#: Side of the blocks in which a component's links are counted.
BLOCK = 2048


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    n = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    out[np.arange(width) < n[:, None]] = values
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    # the greatest number first, so that squares neither overflow nor vanish
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _graphs(nodes: DataFrame, shards: int, width: int) -> DataFrame:
    """Row for each shard with its node numbers, vectors and layers."""

    def send(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterable:
            for batch in given:
                node, x = batch.column("node").to_numpy(), _matrix(batch.column("vector"), width)
                shard = (tokens.mix(node.view(np.uint64)) % np.uint64(shards)).astype(int)
                for s in np.unique(shard):
                    yield int(s), 0, 0, [node[shard == s].tobytes(), _narrow(x[shard == s])]

        yield from batches(rows())

    def work(shard: int, rows: list) -> Iterable:
        node = np.concatenate([np.frombuffer(d[0], np.int64) for _, _, d in rows])
        x = np.concatenate([_wide(d[1], width) for _, _, d in rows])
        order = np.argsort(tokens.mix(node.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)))  # the same graph however rows arrive
        node, x = node[order], x[order]
        g = hnsw.build(_unit(x), tokens.mix(node.view(np.uint64)))
        # of an upper layer only its members have neighbours
        yield shard, 0, shard, [node.tobytes(), _narrow(x), *(part for members, links in g.layers for part in (members.astype(np.int32).tobytes(), links[members].tobytes()))]

    return meet(nodes.mapInArrow(send, SCHEMA), max(1, shards), work)


def _narrow(x: np.ndarray) -> bytes:
    """As single precision where that loses nothing."""
    single = x.astype(np.float32)
    return b"s" + single.tobytes() if (single == x).all() else b"d" + x.tobytes()


def _wide(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, np.float32 if raw[:1] == b"s" else np.float64, offset=1).reshape(-1, width).astype(np.float64)


def _load(data: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, hnsw.Graph]:
    node = np.frombuffer(data[0], np.int64)
    x = _unit(_wide(data[1], width))
    layers = []
    for a, b in zip(data[2::2], data[3::2], strict=True):
        members = np.frombuffer(a, np.int32)
        links = np.frombuffer(b, np.int32).reshape(len(members), -1)
        whole = np.full((len(node), links.shape[1]), -1, np.int32)
        whole[members] = links
        layers.append((members, whole))
    return node, x, hnsw.Graph(x.astype(np.float32), layers)


def _links(nodes: DataFrame, graphs: DataFrame, shards: int, width: int, beam: int, threshold: float) -> DataFrame:
    """``a, b``: nodes of cosine >= threshold, as far as beams show them."""
    groups = -(-parallelism(nodes.sparkSession) // shards)

    def send(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterable:
            for batch in given:
                node, x = batch.column("node").to_numpy(), _matrix(batch.column("vector"), width)
                group = (tokens.mix(node.view(np.uint64) + np.uint64(1)) % np.uint64(groups)).astype(int)
                for g in np.unique(group):
                    data = [node[group == g].tobytes(), _narrow(x[group == g])]
                    for s in range(shards):
                        yield int(s * groups + g), 1, 0, data

        yield from batches(rows())

    def work(part: int, rows: list) -> Iterable:
        if rows[0][0] != 0:
            return
        node, x, graph = _load(rows[0][2], width)
        rows[0] = (0, 0, [])
        for _, _, data in rows[1:]:
            own = np.frombuffer(data[0], np.int64)
            q = _unit(_wide(data[1], width))
            ids, near = graph.search(q.astype(np.float32), min(beam, len(node)))
            r, c = np.nonzero((ids >= 0) & (near >= threshold - 1e-4))
            i = ids[r, c]
            exact = (np.einsum("ij,ij->i", q[r], x[i]) >= threshold) & (own[r] != node[i])
            yield own[r[exact]], node[i[exact]]

    def pairs(found: Iterable) -> Iterator[pa.RecordBatch]:
        for a, b in found:
            if len(a):
                ab = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], names=["a", "b"])

    spread = graphs.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), "source", "data").select((F.col("source") * groups + F.col("g")).cast("long").alias("part"), F.lit(0).alias("kind"), "source", "data")
    return meet(spread.unionByName(nodes.mapInArrow(send, SCHEMA)), shards * groups, work, "a long, b long", pairs)


def _recall(labelled: DataFrame, width: int, threshold: float) -> float:
    """Share of the audited nodes' true links, over all nodes, that lie inside one component."""
    picked = labelled.orderBy(F.xxhash64(F.lit(3), "node"), "node").limit(AUDITED).collect()
    q = np.zeros((len(picked), width))
    for i, r in enumerate(picked):
        q[i, : len(r["vector"])] = r["vector"]
    q, label, own = _unit(q) if len(q) else q, np.array([r["label"] for r in picked], np.int64), np.array([r["node"] for r in picked], np.int64)

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        linked = inside = 0
        for batch in given:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                close = (q @ _unit(_matrix(part.column("vector"), width)).T >= threshold) & (own[:, None] != part.column("node").to_numpy())
                linked += int(close.sum())
                inside += int((close & (label[:, None] == part.column("label").to_numpy())).sum())
        yield pa.RecordBatch.from_arrays([pa.array([linked]), pa.array([inside])], names=["linked", "inside"])

    r = labelled.mapInArrow(run, "linked long, inside long").agg(F.sum("linked").alias("linked"), F.sum("inside").alias("inside")).first()
    return r["inside"] / r["linked"] if r["linked"] else 1.0


def _counted(labelled: DataFrame, width: int, threshold: float) -> DataFrame:
    """``node, others``: rows of other nodes linked with each node of a component of several."""
    sizes = labelled.groupBy("label").agg(F.count("*").alias("many")).where("many > 1")
    blocks = F.ceil(F.col("many") / BLOCK).cast("int")
    member = labelled.join(sizes, "label").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64(F.lit(5), "node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = member.select("label", F.col("own").alias("i"), other.alias("j"), F.lit(0).alias("side"), "node", "copies", "vector")
    right = member.select("label", F.col("own").alias("j"), other.alias("i"), F.lit(1).alias("side"), "node", "copies", "vector").select(*left.columns)

    def count(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        side = t.column("side").to_numpy()
        x = _unit(_matrix(t.column("vector"), width))
        node, copies = t.column("node").to_numpy(), t.column("copies").to_numpy()
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        others = np.zeros(len(a), np.int64)
        for k in range(0, len(a), BLOCK):
            close = (x[a[k : k + BLOCK]] @ x[b].T >= threshold) & (node[a[k : k + BLOCK], None] != node[b])
            others[k : k + BLOCK] = close @ copies[b]
        yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(others)], names=["node", "others"])

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None
        for batch in given:
            key = np.column_stack([batch.column(c).to_numpy() for c in ("label", "i", "j")])
            cut = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1), len(key)]
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                if i == j:
                    continue
                if tuple(key[i]) != at:
                    if held:
                        yield from count(held)
                    held, at = [], tuple(key[i])
                held.append(batch.slice(i, j - i))
        if held:
            yield from count(held)

    n = parallelism(labelled.sparkSession)
    pairs = left.unionByName(right).repartition(n, "label", "i", "j").sortWithinPartitions("label", "i", "j", "side", "node")
    return pairs.mapInArrow(run, "node long, others long").groupBy("node").agg(F.sum("others").alias("others"))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, shard_rows: int = SHARD_ROWS, beam: int = BEAM, recall: float = RECALL) -> DataFrame:
    """Per row: its id, n_links, component_id (the least id reachable by links) and kept."""
    spark = vectors.sparkSession
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    usable = F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = vectors.select(F.col(id_col), v.alias("vector")).select(F.col(id_col), F.when(F.coalesce(usable, F.lit(False)), F.col("vector")).alias("vector"))
    members = stored(rows.withColumn("node", F.when(F.col("vector").isNotNull(), F.xxhash64("vector"))), "near-vectors")
    nodes = stored(members.where(F.col("node").isNotNull()).groupBy("node").agg(F.first("vector").alias("vector"), F.count("*").alias("copies"), F.min(id_col).alias("least_id")), "near-nodes")
    n, width = nodes.agg(F.count("*"), F.max(F.size("vector"))).first()
    shards, width = max(1, -(-n // shard_rows)), width or 1
    graphs = stored(_graphs(nodes.select("node", "vector"), shards, width), "near-graphs")
    while True:
        links = stored(_links(nodes.select("node", "vector"), graphs, shards, width, beam, threshold), "near-links")
        release(spark)
        labels = components(links)
        labelled = stored(nodes.join(labels, "node", "left").select("node", "vector", "copies", "least_id", F.coalesce("label", "node").alias("label")), "near-labels")
        if beam >= min(n, shard_rows) or _recall(labelled.select("node", "vector", "label"), width, threshold) >= recall:
            break
        beam *= 2
    found = labelled.select("node", "copies", "label", "least_id").join(_counted(labelled, width, threshold), "node", "left")
    least = found.groupBy("label").agg(F.min("least_id").alias("component_id"))
    about = found.join(least, "label").select("node", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    out = members.join(about, "node", "left").select(id_col, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", F.col(id_col)).alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def op5_near_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
