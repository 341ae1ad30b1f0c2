"""Embeddings by pluggable encoders, computed once for each distinct text, and k-means labels."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.functions import text as fn


class Encoder(Protocol):
    """Made once in each Python worker by ``open``; ``encode`` gets batches of texts."""

    name: str

    def open(self): ...


class HashingEncoder:
    """Deterministic, offline: signed hashes of words and of letter triples, of unit length.

    A word's sum of hashes is made once and kept by the worker, so that a text costs
    a look-up and a row of a table for each word. All sums are of whole numbers, hence exact in any order.
    """

    #: Words that are looked up and letters that are hashed at a time; words and letters after which a worker keeps no more, but begins anew.
    portion, letters, kept_words, kept_letters = 1 << 15, 1 << 20, 1 << 17, 1 << 23

    def __init__(self, width: int = 64):
        self.width, self.name = width, f"hashing-{width}"

    def open(self):
        import xxhash

        known: dict[str, int] = {}
        table, kept = np.zeros((0, self.width), np.int32), 0

        def signed(hashes: list[int]) -> tuple[np.ndarray, np.ndarray]:
            h = np.array(hashes, np.uint64)
            return (h % np.uint64(self.width)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)

        def sums(words: list[str]) -> np.ndarray:
            """A row for each word. In the words with single spaces around, each letter with its neighbours is a triple."""
            slot, sign = signed([xxhash.xxh64_intdigest(w) for w in words])
            out = np.zeros((len(words), self.width), np.int32)
            out[np.arange(len(words)), slot] += sign.astype(np.int32)
            spaced, first = f" {' '.join(words)} ", 0
            for k in range(0, len(spaced) - 2, self.letters):
                c = np.frombuffer(spaced[k : k + self.letters + 2].encode("utf-32-le"), "<u4").astype(np.int64)
                letter = c[1:-1] != 32
                word = first + np.cumsum(~letter)
                distinct, at = np.unique((c[:-2] << 42 | c[1:-1] << 21 | c[2:])[letter], return_inverse=True)
                drawn = np.stack([distinct >> 42, distinct >> 21 & 0x1FFFFF, distinct & 0x1FFFFF], 1).astype("<u4").tobytes().decode("utf-32-le")
                slot, sign = signed([xxhash.xxh64_intdigest(drawn[i : i + 3]) for i in range(0, len(drawn), 3)])
                of = word[letter] - first
                n = int(word[-1]) - first + 1
                out[first : first + n] += np.bincount(of * self.width + slot[at], sign[at], n * self.width).reshape(n, self.width).astype(np.int32)
                first += n - 1
            return out

        def rows(words: list[str]) -> np.ndarray:
            """Places in the table, to which words that are new are added."""
            nonlocal table, kept
            new = [w for w in dict.fromkeys(words) if w not in known]
            if new and (len(known) + len(new) > self.kept_words or kept > self.kept_letters):
                known.clear()
                kept, new = 0, list(dict.fromkeys(words))
            if new:
                n = len(known)
                if n + len(new) > len(table):
                    room = max(n + len(new), min(2 * n, self.kept_words))
                    table = np.concatenate([table[:n], np.zeros((room - n, self.width), np.int32)])
                table[n : n + len(new)] = sums(new)
                known.update(zip(new, range(n, n + len(new)), strict=True))
                kept += sum(map(len, new))
            return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), self.width), np.int64)
            words: list[str] = []
            spans: list[tuple[int, int, int]] = []  # text, first word and end in the portion

            def add() -> None:
                at = rows(words)
                for i, a, b in spans:
                    out[i] += table[at[a:b]].sum(axis=0)
                words.clear()
                spans.clear()

            for i, t in enumerate(texts):
                of = (t or "").lower().split()
                for k in range(0, len(of), self.portion):
                    piece = of[k : k + self.portion]
                    if len(words) + len(piece) > self.portion:
                        add()
                    spans.append((i, len(words), len(words) + len(piece)))
                    words += piece
            add()
            out = out.astype(np.float32)
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            return out / np.where(norm > 0, norm, 1)

        return encode


class SentenceEncoder:
    """A sentence-transformers model, where that library and the model are at hand."""

    def __init__(self, model: str = "intfloat/multilingual-e5-small", batch: int = 32):
        self.model, self.batch, self.name = model, batch, model

    def open(self):
        from sentence_transformers import SentenceTransformer

        model = SentenceTransformer(self.model)
        return lambda texts: model.encode(texts, batch_size=self.batch, normalize_embeddings=True, convert_to_numpy=True).astype("float32")


def embed(df: DataFrame, text_col: str, encoder: Encoder, out: str = "embedding") -> DataFrame:
    @F.pandas_udf("array<float>")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder.open()
        for s in batches:
            yield pd.Series(list(encode(s.fillna("").tolist())), index=s.index)

    return df.withColumn(out, encoded(F.col(text_col)))


def with_unit_hash(units: DataFrame, text_col: str, version: str) -> DataFrame:
    return units.withColumn("unit_hash", fn.row_hash(version, F.col("source_id"), F.col("chat_name"), F.col("timestamp"), F.col(text_col)))


def hash_of_hashes(df: DataFrame, column: str, version: str) -> DataFrame:
    """One row, ``key``: sha256 of all hashes with their counts, in whatever order the rows lie.

    Equal hashes are counted first, and 4096 lists by the first three digits are
    hashed before these are: no task holds all hashes.
    """
    counted = df.groupBy(F.col(column).alias("h")).agg(F.count("*").alias("n"))
    of = lambda items: F.sha2(F.array_join(F.array_sort(F.collect_list(items)), "\n"), 256)
    parts = counted.groupBy(F.substring("h", 1, 3).alias("p")).agg(of(F.concat_ws(":", "h", "n")).alias("x"))
    return parts.agg(F.sha2(F.concat(F.lit(version + "\n"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "p", "x"))), "\n")), 256).alias("key"))


def cache_delta(units: DataFrame, cache: DataFrame, key: str = "unit_hash") -> tuple[DataFrame, DataFrame]:
    """Distinct keys to encode, and cached rows that stay in use."""
    keys = units.select(key).distinct()
    return keys.join(cache.select(key), key, "left_anti"), cache.join(keys, key, "left_semi")


def embed_incrementally(units: DataFrame, cache: DataFrame, text_col: str, encoder: Encoder, key: str = "unit_hash") -> DataFrame:
    """``units`` with embedding; ``cache`` has the key and embedding. Equal keys are encoded once."""
    missing, reused = cache_delta(units, cache, key)
    new = embed(units.dropDuplicates([key]).join(missing, key, "left_semi").select(key, text_col), text_col, encoder).drop(text_col)
    return units.join(reused.select(key, "embedding").unionByName(new), key)


def cluster_count(n: int) -> int:
    return 1 if n < 30 else max(6, min(24, int((n / 180) ** 0.5)))


def kmeans_labels(units: DataFrame, vector_col: str = "embedding", out: str = "style_cluster", sample: int = 50_000, seed: int = 42) -> DataFrame:
    """Labels from centres trained on a seeded sample of at most ``sample`` rows."""
    n = units.count()
    if n < 30:
        return units.withColumn(out, F.lit(0))
    v = units.withColumn("features", array_to_vector(F.transform(vector_col, lambda x: x.cast("double"))))
    train = v.orderBy(F.rand(seed)).limit(sample) if n > sample else v
    model = KMeans(k=cluster_count(n), maxIter=20, seed=seed).fit(train.select("features"))
    return model.setPredictionCol(out).transform(v).drop("features")
