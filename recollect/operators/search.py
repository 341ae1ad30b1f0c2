"""Exact inner-product search for a batch of queries, and what follows it: rerank, dedup, diversify, merge."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window

from recollect.functions import scores
from recollect.functions import text as fn
from recollect.operators import embed

#: Queries that are sent to all tasks at a time; more are searched for in blocks.
BLOCK = 1024
#: Digits that decide between scores: sums of products differ behind these with their order.
DIGITS = 9


def top_k(units: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str = "embedding", query_id: str = "qid", query_vector: str = "qv") -> DataFrame:
    """``qid``, the id and the score of each query's k best units; ties go to the lesser id.

    Every task multiplies its rows with the queries and keeps k for each; only
    those are ranked against each other. Ids and vectors are all that is read.
    """
    blocks: list[list] = [[]]
    for r in queries.select(query_id, query_vector).where(F.col(query_vector).isNotNull()).toLocalIterator():
        if len(blocks[-1]) == BLOCK:
            blocks.append([])
        blocks[-1].append((r[0], list(r[1])))
    found = [_top_k_block(units, b, k, id_col, vector_col, queries.schema[query_id].dataType) for b in blocks if b or len(blocks) == 1]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def _top_k_block(units: DataFrame, block: list, k: int, id_col: str, vector_col: str, qid_type) -> DataFrame:
    id_type = units.schema[id_col].dataType
    q = np.array([v for _, v in block], np.float64) if block else np.zeros((0, 1))
    qids = [i for i, _ in block]
    schema = StructType([StructField("qid", qid_type), StructField(id_col, id_type), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray] | None] = [None for _ in qids]
        for batch in batches:
            v = batch.column(vector_col)
            ids = batch.column(id_col).to_numpy(zero_copy_only=False)
            if not len(ids):
                continue
            x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)
            s = x @ q.T
            for j, had in enumerate(best):
                own = np.round(s[:, j], DIGITS)
                near = np.flatnonzero(own >= np.partition(own, -k)[-k]) if len(own) > k else np.arange(len(own))
                i, c = ids[near], s[near, j]
                if had is not None:
                    i, c = np.concatenate([had[0], i]), np.concatenate([had[1], c])
                first = np.lexsort((i, -np.round(c, DIGITS)))[:k]
                best[j] = i[first], c[first]
        for qid, found in zip(qids, best, strict=True):
            if found is not None:
                yield pa.RecordBatch.from_arrays([pa.array([qid] * len(found[0]), to_arrow_type(qid_type)), pa.array(found[0].tolist(), to_arrow_type(id_type)), pa.array(found[1])], names=["qid", id_col, "score"])

    near = units.where(F.col(vector_col).isNotNull() & (F.size(vector_col) == q.shape[1])).select(id_col, vector_col).mapInArrow(run, schema)
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("score", DIGITS)), id_col)
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def contact_hints(queries: DataFrame, chats: DataFrame) -> DataFrame:
    """``qid, contact``: the first chat (by ``source``, then ``pos``) whose name the query mentions.

    Query words and name lengths are not bounded, so names are looked up as
    pieces of the query: each query gives its substrings of the lengths that
    names have, and these are joined by equality.
    """
    names = chats.groupBy(F.lower("chat_name").alias("name")).agg(F.min(F.struct("source", "pos", "chat_name")).alias("first")).where("name <> ''")
    lengths = [r[0] for r in names.select(F.length("name")).distinct().collect()]
    if not lengths:
        return queries.select("qid", F.lit(None).cast("string").alias("contact")).limit(0)
    q = F.lower("query")

    def substrings(n: int) -> Column:
        return F.when(F.length(q) >= n, F.transform(F.sequence(F.lit(1), F.length(q) - n + 1), lambda i: F.substring(q, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    pieces = F.flatten(F.array(*map(substrings, lengths)))
    hits = queries.select("qid", F.explode(F.array_distinct(pieces)).alias("name")).join(names, "name")
    return hits.groupBy("qid").agg(F.min("first").alias("f")).select("qid", F.col("f.chat_name").alias("contact"))


def rerank(hits: DataFrame, role: str, newest: Column, min_score: float, default_signal: float = 0.4) -> DataFrame:
    """Adds rank_score. ``hits`` may have ``contact``, the query's chat."""
    signal = scores.signal_or_default(F.col("signal_score"), default_signal)
    contact = F.when(F.col("contact") == F.col("chat_name"), 1.0).otherwise(0.0) if "contact" in hits.columns else F.lit(0.0)
    if role == "response":
        rank = F.col("score") + 0.08 * signal + scores.recency(F.col("timestamp"), newest, 0.05) + 0.04 * contact + scores.gap_bonus(F.col("reply_gap_min"))
    else:
        words = fn.token_len(fn.collapse(F.coalesce("style_text", F.lit(""))))
        rank = F.col("score") + 0.07 * signal + scores.recency(F.col("timestamp"), newest, 0.04) + 0.03 * contact + scores.length_bonus(words)
    return hits.where(F.round("score", DIGITS) >= min_score).withColumn("rank_score", rank).withColumn("retrieval_role", F.lit(role))


def _by_rank(*more: str) -> list[Column]:
    return [F.desc(F.round("rank_score", DIGITS)), F.desc(F.round("score", DIGITS)), *map(F.col, more)]


def first_per_source(ranked: DataFrame, k: int, tie: str) -> DataFrame:
    own = Window.partitionBy("qid", "source_id").orderBy(*_by_rank(tie))
    best = ranked.withColumn("rn", F.row_number().over(own)).where("rn = 1")
    return best.withColumn("rn", F.row_number().over(Window.partitionBy("qid").orderBy(*_by_rank("source_id", tie)))).where(F.col("rn") <= k)


def round_robin(ranked: DataFrame, k: int, tie: str, cluster_col: str = "style_cluster") -> DataFrame:
    """A text from each cluster in turn, clusters by their best rank, no text twice. A query's candidates, a few times k, are one group."""
    schema = StructType([*ranked.schema.fields, StructField("rn", LongType())])
    keyed = ranked.withColumn("fuzzy", fn.fuzzy_key(F.col("style_text"))).withColumn("order", F.row_number().over(Window.partitionBy("qid").orderBy(*_by_rank(tie))))

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("order")
        waiting = [list(rows.index) for _, rows in sorted(group.groupby(cluster_col, dropna=False), key=lambda x: x[1]["order"].iloc[0])]
        seen, picked = {""}, []
        while waiting and len(picked) < k:
            for rows in waiting:
                while rows and group.at[rows[0], "fuzzy"] in seen:
                    rows.pop(0)
                if rows and len(picked) < k:
                    picked.append(rows.pop(0))
                    seen.add(group.at[picked[-1], "fuzzy"])
            waiting = [rows for rows in waiting if rows]
        return group.loc[picked].assign(rn=range(1, len(picked) + 1)).drop(columns=["fuzzy", "order"])

    return keyed.groupBy("qid").applyInPandas(pick, schema)


def merged(response_hits: DataFrame, style_hits: DataFrame, k: int, tie: str) -> DataFrame:
    both = response_hits.drop("rn").unionByName(style_hits.drop("rn"), allowMissingColumns=True)
    w = Window.partitionBy("qid").orderBy(*_by_rank("retrieval_role", tie))
    return both.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def newest(units: DataFrame) -> Column:
    """The latest timestamp as a literal."""
    ts = units.agg(F.max("timestamp")).first()[0]
    return F.lit(ts).cast("timestamp_ntz")


def first_seen(response: DataFrame, style: DataFrame) -> DataFrame:
    """``chat_name, source, pos``: chats in the order in which the units, by time, first name them: response units first."""
    pos = F.struct(F.col("timestamp").isNull().alias("undated"), "timestamp")
    both = response.select("chat_name", F.lit(0).alias("source"), pos.alias("pos")).unionByName(style.select("chat_name", F.lit(1).alias("source"), pos.alias("pos")))
    return both.where("chat_name IS NOT NULL").groupBy("chat_name").agg(F.min(F.struct("source", "pos")).alias("first")).select("chat_name", "first.source", "first.pos")


def retrieve_bundle(queries: DataFrame, response: DataFrame, style: DataFrame, k_response: int = 6, k_style: int = 8, min_score: float = 0.22, tie: str = "unit_hash") -> tuple[DataFrame, DataFrame]:
    """Response and style hits of each query (``qid, query, qv``). Wide columns are joined after the search."""
    hints = contact_hints(queries, first_seen(response, style))

    def hits(units: DataFrame, role: str, k: int, floor: int, least: float) -> DataFrame:
        near = top_k(units, queries, max(floor, 8 * k), tie).drop("rank").join(units.drop("embedding"), tie).join(hints, "qid", "left")
        return rerank(near, role, newest(units), least)

    return first_per_source(hits(response, "response", k_response, 60, min_score), k_response, tie), round_robin(hits(style, "style", k_style, 80, 0.9 * min_score), k_style, tie)


def retrieve(queries: DataFrame, response: DataFrame, style: DataFrame, k_total: int = 10, min_score: float = 0.22, tie: str = "unit_hash") -> DataFrame:
    a, b = retrieve_bundle(queries, response, style, max(4, k_total // 2), max(4, k_total), min_score, tie)
    return merged(a, b, k_total, tie)


def ask(texts: list[str], response: DataFrame, style: DataFrame, encoder: embed.Encoder, k_total: int = 10, min_score: float = 0.22, tie: str = "unit_hash") -> DataFrame:
    """``retrieve`` for texts, which the units' own encoder embeds; ``qid`` is a text's position."""
    queries = response.sparkSession.createDataFrame(list(enumerate(texts)), "qid int, query string")
    return retrieve(embed.embed(queries, "query", encoder, "qv"), response, style, k_total, min_score, tie)
