"""From raw documents to shards of training data, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it
kept, and its result is written and read again before the next one starts. All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import decontamination, jaccard, mixing, quality, sharding
from recollect.llm.common import aside, stored, table

#: Words of a shingle and least Jaccard similarity in percent; op4's own contract binds only its query.
SHINGLE = 5
PERCENT = 80


def _harmless(docs: DataFrame, *read: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with all columns but those that an operator reads under names that clash with none of its own, and the way back."""
    safe, names = aside(docs, list(read))
    return safe, [F.col(names.get(c, c)).alias(c) for c in docs.columns]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go.

    Null and empty texts are scored as texts without words, null metadata as
    values of their own; repeated rows fare alike; an empty table stays empty;
    further columns pass through, whatever their names.
    """
    safe, back = _harmless(docs, "doc_id", "text", *quality.METADATA)
    model = quality.fit(safe, table(spark, sf_dir, "labels"))
    return quality.score_quality(safe, model).where("keep_document").select(*back)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group the document of the least id stays.

    Null, empty and wordless texts are no group and stay, all of them. Of rows
    that share the least id, or have none, one stays for each text set; texts
    may be long; an empty table stays empty; further columns pass through.
    """
    safe, back = _harmless(docs, "doc_id", "text")
    classes = jaccard.jaccard_classes(safe, shingle=SHINGLE, percent=PERCENT)
    first = classes.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(F.col("doc_id").alias("first_id"), F.col("node").alias("first_node"))
    first = stored(first.agg(((F.count("*") > 1) & (F.max("n_shingles") > 0)).alias("repeated")), "pipeline-first")
    with_node = jaccard.shingle_sets(safe, "text", SHINGLE, safe.columns)

    def named(which: DataFrame) -> DataFrame:
        return with_node.join(which, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("node") == F.col("first_node")), "left_semi")

    kept = named(first.where("not repeated")).select(*back)
    again = first.where("repeated")
    # texts are dealt by id a second time only if there are such rows
    return kept if again.isEmpty() else kept.unionByName(named(again).dropDuplicates(["doc_id", "node"]).select(*back))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents with a window of any item go; a training corpus must not hold even one.

    Null and empty texts hold none and stay; repeated rows fare alike; without
    benchmark items all stay; further columns pass through.
    """
    safe, back = _harmless(docs, "doc_id", "text")
    found = decontamination.decontaminate(safe, table(spark, sf_dir, "benchmark"), min_items=1)
    return found.where("not contaminated").select(*back)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: documents leave, stay or are repeated.

    A null source is one of its own and the last; repeated rows are
    documents of their own; an empty table stays empty; further columns pass
    through.
    """
    safe, back = _harmless(docs, "doc_id", "text", "source")
    times = mixing.mix(safe).where("repeats > 0").withColumn("repeats", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))))
    return times.select(*back)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sharding: every row gets its shard and slot; null ids and repeated rows are dealt too, and an empty table has no shards."""
    return sharding.shard(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources to target weights", mix_sources),
    ("sharding", deal_shards),
]
#: Trained weights and sketches decide which rows stay: SQL cannot say which. Tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
