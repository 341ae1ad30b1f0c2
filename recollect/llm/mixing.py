"""Mixing sources to target weights by capped water-filling.

The targets share the total size by weight; a source stops at a maximum number
of epochs of its size, and what it cannot take is shared among the others by
weight until no target is above its cap. Then every document is taken as often
as its source's target holds whole repetitions, and a seeded sample of the
source's documents once more for the fraction.

That sample takes documents in hash order while they fit. Each source is cut
by hash into many bins whose sizes are summed before anything is ordered, so
only documents of the one bin in which the fraction ends are ordered, and a
hot source is never gathered in one task. Of the documents left, the one whose
size is nearest to what is missing closes the gap.

Cases: null sources are one source, last in order; null or empty texts have
size 0 and take 0; sources of size 0 have target 0; repeated rows are sampled
one by one; an empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from recollect.llm import tokens
from recollect.llm.common import annotate, aside, stored, table

MAX_EPOCHS = 3
SEED = 29
#: Most sources whose plan is broadcast: about 10 MB.
BROADCAST_SOURCES = 100_000
_BINS = 4096
FIELDS = [("size", T.LongType())]
RESULTS = ("size", "source_size", "target", "repeats", "taken")


def _counter(text_col: str):
    def make():
        def run(batch: pa.RecordBatch) -> list:
            return [tokens.tokenise(batch.column(text_col), tokens.WHITESPACE_WORDS, lower=False).counts]

        return run

    return make


def level(sources: DataFrame, max_epochs: int) -> float:
    """Target per unit of weight of the sources below their caps: it rises as sources reach theirs, until none is above."""
    cap = F.col("source_size") * max_epochs
    height, before = 0.0, -1.0
    while height > before:
        over = F.lit(height) * F.col("weight") > cap
        r = sources.agg(F.sum("source_size").alias("total"), F.sum(F.when(over, cap)).alias("capped"), F.sum(F.when(~over, F.col("weight"))).alias("open")).first()
        before, height = height, ((r["total"] or 0) - (r["capped"] or 0)) / r["open"] if r["open"] else height
    return height


def placed(sources: DataFrame) -> DataFrame:
    """``sources`` with their place in order, from 0: each range of them is numbered in its own task, and one task adds up only the ranges' counts."""
    dealt = stored(sources.repartitionByRange("mix_source").withColumn("range", F.spark_partition_id()), "mixing-ranges")
    counts = dealt.groupBy("range").agg(F.count("*").alias("n"))
    before = counts.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("range").orderBy("mix_source"))
    return dealt.join(before, "range").withColumn("place", F.col("before") + own - 1).drop("range", "before")


def mix(docs: DataFrame, weights: DataFrame | None = None, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", max_epochs: int = MAX_EPOCHS, seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (columns ``keep``) with size, source_size, target, repeats and taken.

    ``weights`` has ``source`` and ``weight``; without it sources by code
    point, null last, weigh 1, 2, 3, repeating. Columns of ``docs`` that have
    the names of the five results are replaced by these; all others come back
    as they are, whatever their names.
    """
    shown = [c for c in (docs.columns if keep is None else keep) if c not in RESULTS]
    docs, names = aside(docs, [source_col, text_col, id_col])
    out = _mixed(docs, weights, source_col, text_col, id_col, max_epochs, seed, [names.get(c, c) for c in shown])
    return out.select(*(F.col(names.get(c, c)).alias(c) for c in shown), *RESULTS)


def _mixed(docs: DataFrame, weights: DataFrame | None, source_col: str, text_col: str, id_col: str, max_epochs: int, seed: int, keep: list[str]) -> DataFrame:
    sized = annotate(docs, text_col, FIELDS, _counter(text_col), list(dict.fromkeys([*keep, source_col, id_col])))
    uid = F.monotonically_increasing_id().alias("mix_uid")
    base = stored(sized.select("*", uid), "mixing")
    # the uid tells repeated rows apart; it is fixed by the stored table
    base = base.withColumn("mix_hash", F.xxhash64(F.lit(seed), F.col(id_col), "size")).withColumn("mix_bin", F.pmod(F.shiftright("mix_hash", 20), F.lit(_BINS)).cast("int")).withColumn("mix_source", F.struct(F.col(source_col).isNull().alias("none"), F.coalesce(F.col(source_col), F.lit("")).alias("name")))
    bins = base.groupBy("mix_source", "mix_bin").agg(F.sum("size").alias("bin_size"))
    sources = bins.groupBy("mix_source").agg(F.sum("bin_size").alias("source_size"))
    if weights is None:
        sources = placed(sources).withColumn("weight", (F.pmod("place", F.lit(3)) + 1).cast("double")).drop("place")
    else:
        w = weights.select(F.struct(F.col("source").isNull().alias("none"), F.coalesce(F.col("source"), F.lit("")).alias("name")).alias("mix_source"), F.col("weight").cast("double").alias("weight"))
        sources = sources.join(w, "mix_source", "left").fillna(0.0, ["weight"])
    sources = stored(sources, "mixing-sources")
    # a table of one row a source goes to all tasks only while it is small; beyond that it is joined by source
    near = F.broadcast if sources.count() <= BROADCAST_SOURCES else (lambda x: x)
    height = level(sources, max_epochs)
    target = F.least(F.lit(float(height)) * F.col("weight"), (F.col("source_size") * max_epochs).cast("double"))
    sources = sources.withColumn("target", target).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    sources = sources.withColumn("rest", F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))

    w = Window.partitionBy("mix_source").orderBy("mix_bin")
    edge = bins.withColumn("upto", F.sum("bin_size").over(w)).join(sources, "mix_source").where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("bin_size") <= F.col("rest")))
    # at the first such bin the fraction ends: bins before it are taken, none after it
    edge = edge.groupBy("mix_source").agg(F.min(F.struct("mix_bin", (F.col("rest") - F.col("upto") + F.col("bin_size")).alias("left"))).alias("edge"))
    plan = sources.join(edge, "mix_source", "left").select("mix_source", "source_size", "target", "whole", F.coalesce(F.col("edge.mix_bin"), F.lit(_BINS)).alias("edge_bin"), F.coalesce(F.col("edge.left"), F.lit(0)).alias("edge_left"))
    plan = stored(plan, "mixing-plan")

    inside = base.join(near(plan.select("mix_source", F.col("edge_bin").alias("mix_bin"), "edge_left")), ["mix_source", "mix_bin"])
    order = Window.partitionBy("mix_source").orderBy("mix_hash", id_col, "mix_uid")
    inside = inside.select("mix_source", "mix_uid", "size", "edge_left", F.sum("size").over(order).alias("upto"))
    fits = inside.where(F.col("upto") <= F.col("edge_left"))
    missing = plan.join(fits.groupBy("mix_source").agg(F.sum("size").alias("got")), "mix_source", "left").select("mix_source", "edge_bin", (F.col("edge_left") - F.coalesce("got", F.lit(0))).alias("gap"))
    fits = stored(fits.select("mix_source", "mix_uid"), "mixing-edge")
    free = base.join(near(missing.where("gap > 0")), "mix_source").where(F.col("mix_bin") >= F.col("edge_bin")).where(F.abs(F.col("size") - F.col("gap")) < F.col("gap"))
    free = free.join(fits, ["mix_source", "mix_uid"], "left_anti")
    last = free.groupBy("mix_source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), F.col("mix_hash"), F.col("mix_uid"))).alias("best")).select("mix_source", F.col("best.mix_uid").alias("mix_uid"))
    once = fits.unionByName(last).select(F.col("mix_source"), "mix_uid", F.lit(1).alias("more"))

    out = base.join(near(plan), "mix_source").join(once, ["mix_source", "mix_uid"], "left")
    extra = F.when(F.col("mix_bin") < F.col("edge_bin"), F.when(F.col("edge_bin") < _BINS, 1).otherwise(F.lit(0))).otherwise(F.coalesce("more", F.lit(0)))
    repeats = (F.col("whole") + extra).cast("long")
    return out.select(*keep, "size", "source_size", "target", repeats.alias("repeats"), (F.col("size") * repeats).alias("taken"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", "size", "source_size", "target", "taken")
