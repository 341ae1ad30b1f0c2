"""What the operators share: shared-folder tables, pass-through maps, columns set aside."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from recollect.llm import tokens

#: Only where the session names no shared folder and all of Spark is one process, as in tests.
LOCAL_FALLBACK = "file:///tmp/checkpoints"
#: Bytes of a batch of rows on its way to Python and back; Spark's own bound is 16 times as wide.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; without one only a single-process session can go on."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = LOCAL_FALLBACK
    return f"{root.rstrip('/')}/recollect/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table of ``stored`` that nothing reads any more, and lets Spark drop shuffles of ended jobs."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Asks the driver's JVM to collect garbage: only then does Spark delete the shuffle files of ended jobs."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``df.mapInArrow`` in batches of bounded bytes, after which a worker gives the memory back that it has freed.

    Workers outlive their tasks; without that, each keeps the most it ever used
    beside an executor's heap.
    """
    # a bound that the session has narrowed itself stays
    bound = df.sparkSession.conf.get(_BATCH_SETTING, None)
    if bound is None or int("".join(c for c in bound if c.isdigit()) or 0) > BATCH_BYTES or int("".join(c for c in bound if c.isdigit()) or 0) <= 0:
        df.sparkSession.conf.set(_BATCH_SETTING, str(BATCH_BYTES))

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(lean, schema)


def give_back() -> None:
    """Returns freed memory to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def without(names: list[str], taken: list[str]) -> list[str]:
    """The names that are none of ``taken``, whatever their case: to Spark ``Size`` and ``size`` are one."""
    gone = {t.lower() for t in taken}
    return [n for n in names if n.lower() not in gone]


def aside(df: DataFrame, own: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with all columns but ``own`` under names that no operator uses; and these names by the columns'."""
    names = {c: f"aside_{i}_{uuid.uuid4().hex[:8]}" for i, c in enumerate(df.columns) if c not in own}
    return df.toDF(*(names.get(c, c) for c in df.columns)), names


def annotate(docs: DataFrame, text_col: str, fields: list[tuple[str, T.DataType]], make: Callable[[], Callable], keep: list[str] | None = None, limit: int = 4 << 20) -> DataFrame:
    """``docs`` with new columns computed per row.

    ``make`` runs once in each task and returns ``f(batch) -> list of arrays``,
    one for each of ``fields``. Columns of ``keep`` (all by default) pass
    through; one with a new column's name is replaced by the new column.
    Without ``text_col`` in the input the text is null throughout.
    """
    names = without(docs.columns if keep is None else keep, [name for name, _ in fields])
    need = list(dict.fromkeys([*names, text_col]))
    schema = T.StructType([*(docs.schema[c] for c in names), *(T.StructField(n, t) for n, t in fields)])
    arrow = [to_arrow_type(t) for _, t in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in tokens.chunks(batches, text_col, limit):
            columns = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(f(batch), arrow, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *columns], names=[*names, *(n for n, _ in fields)])

    return mapped(docs.select(*need), run, schema)
