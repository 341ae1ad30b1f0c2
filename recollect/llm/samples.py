"""Bounded, seeded samples of labelled rows, for fitting classifiers on the driver.

The bound is in rows, and in bytes of text where the texts' words themselves go
to the driver; both are parameters of the fitting operators. Rows are taken in the order of a hash of their id, so that a sample
does not depend on how the table is laid out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 41
ROWS = 4_000


def fold(id_col: str, parts: int) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts))


def labelled_ids(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, where: Column | None, rows: int = ROWS, size: int | None = None) -> tuple[DataFrame, dict[int, int]]:
    """Ids and labels of at most ``rows`` documents of either label and, if given, ``size`` bytes of text in all; and how many rows have each label.

    A document with several labels has the greatest; null ids and labels are
    left out.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("label")).where(F.col(id_col).isNotNull() & F.col("label").isNotNull())
    known = known.where(where) if where is not None else known
    known = known.groupBy(id_col).agg(F.max("label").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    order = F.xxhash64(F.lit(SEED), F.col(id_col))
    picked = [r for y in counts for r in known.where(F.col("label") == y).orderBy(order, id_col).limit(rows).collect()]
    ids = spark.createDataFrame([(r[0], r[1]) for r in picked], known.schema)
    if size is None:
        return ids, counts
    lengths = {r[0]: r[1] for r in docs.select(id_col, F.octet_length(text_col).alias("n")).join(F.broadcast(ids), id_col).groupBy(id_col).agg(F.sum("n").alias("n")).collect()}
    kept, left = [], {y: size // max(1, len(counts)) for y in counts}
    for r in picked:
        n = lengths.get(r[0]) or 0
        if n <= left[r[1]]:
            left[r[1]] -= n
            kept.append((r[0], r[1]))
    return spark.createDataFrame(kept, known.schema), counts
