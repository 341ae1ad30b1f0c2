"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns many points of a ring of 64-bit hashes. A document goes to
the shard of the next point clockwise; where that shard is full, it continues
to the next point of another shard. Loads are bounded by the law ``rows``: the
shards' capacities are the whole parts of rows / shards, one more for the
first ``rows % shards`` shards, so that all end up full and their counts are
at most one apart.

Documents arrive in ring order. All documents of an arc (between two points)
see the same sequence of shards, so the number of documents in each arc, a
table as long as the ring has points, settles everything: a document needs
only its rank in its arc to know its shard and slot. That rank is the one
shuffle, of ids and sizes without texts.

Cases: a null text has size 1 and the checksum of an empty text; null ids hash
to one place of the ring; repeated rows are rows and get their own slots; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.llm.common import table

SHARDS = 8
VIRTUAL_NODES = 512
SEED = 17
_CELL_BITS = 12


def ring(shards: int, virtual_nodes: int) -> list[tuple[int, int]]:
    """Points of the ring in order, with their shards. More shards add points and move none."""
    place = lambda s, v: int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big", signed=True)
    return sorted((place(s, v), s) for s in range(shards) for v in range(virtual_nodes))


def clockwise(points: list[tuple[int, int]], arc: int) -> list[int]:
    """The shards that documents of an arc try, in order."""
    return list(dict.fromkeys(points[(arc + i) % len(points)][1] for i in range(len(points))))


def fill(points: list[tuple[int, int]], shards: int, counts: dict[int, int]) -> dict[int, list[tuple[int, int, int]]]:
    """For each arc its pieces (last rank, shard, slot of rank 0): arcs arrive in ring order, full shards are passed over."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    out = {}
    for arc in sorted(counts):
        rank, pieces = 0, []
        for s in clockwise(points, arc):
            n = min(counts[arc] - rank, room[s] - used[s])
            if n:
                pieces.append((rank + n - 1, s, used[s] - rank))
                used[s], rank = used[s] + n, rank + n
            if rank == counts[arc]:
                break
        out[arc] = pieces
    return out


def _with_arc(rows: DataFrame, points: list[tuple[int, int]], key: Column) -> DataFrame:
    """Adds ring_hash and ring_arc. The ring is cut into cells of equal width, so that a lookup compares with a few points only."""
    cells = 1 << _CELL_BITS
    of = [(p >> (64 - _CELL_BITS)) + cells // 2 for p, _ in points]
    begun = _begun(of, cells)
    rows_ = [(k, begun[k], [p for p, _ in points[begun[k] : begun[k + 1]]]) for k in range(cells)]
    grid = rows.sparkSession.createDataFrame(rows_, "ring_cell int, ring_begun int, ring_points array<long>")
    at = rows.withColumn("ring_hash", F.xxhash64(F.lit(SEED), key)).withColumn("ring_cell", (F.shiftright("ring_hash", 64 - _CELL_BITS) + cells // 2).cast("int"))
    passed = F.size(F.filter("ring_points", lambda p: p < F.col("ring_hash")))
    return at.join(F.broadcast(grid), "ring_cell").withColumn("ring_arc", F.pmod(F.col("ring_begun") + passed, F.lit(len(points))).cast("int")).drop("ring_cell", "ring_begun", "ring_points")


def _begun(of: list[int], cells: int) -> list[int]:
    n = [0] * (cells + 1)
    for c in of:
        n[c + 1] += 1
    return list(accumulate(n))


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", virtual_nodes: int = VIRTUAL_NODES, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (columns ``keep``, all by default) with size, text_crc32, shard and slot."""
    spark = docs.sparkSession
    new = {"size", "text_crc32", "shard", "slot"}
    names = [c for c in (docs.columns if keep is None else keep) if c not in new]
    points = ring(shards, virtual_nodes)
    key = F.col(id_col)
    counts = {r["ring_arc"]: r["count"] for r in _with_arc(docs.select(id_col), points, key).groupBy("ring_arc").count().collect()}
    pieces = fill(points, shards, counts)
    plan = spark.createDataFrame([(arc, x) for arc, x in pieces.items()], "ring_arc int, ring_pieces array<struct<last:long,shard:int,base:long>>")
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(*{c: F.col(c) for c in [*names, id_col]}.values(), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    w = Window.partitionBy("ring_arc").orderBy("ring_hash", key, "size", "text_crc32")
    ranked = _with_arc(rows, points, key).withColumn("ring_rank", (F.row_number().over(w) - 1).cast("long"))
    placed = ranked.join(F.broadcast(plan), "ring_arc").withColumn("ring_piece", F.filter("ring_pieces", lambda p: p["last"] >= F.col("ring_rank"))[0])
    return placed.select(*names, "size", "text_crc32", F.col("ring_piece.shard").alias("shard"), (F.col("ring_rank") + F.col("ring_piece.base")).alias("slot"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
