"""Tables, manifests and small state that make rebuilds incremental."""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from recollect import schemas


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A parquet table; one that is not there is empty."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def write_table(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Replaces a table, or with ``partition`` only the partitions that ``df`` has."""
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if partition else "static")
    (w.partitionBy(partition) if partition else w).parquet(path)


def read_json(spark: SparkSession, path: str, default):
    """Small state; missing or broken files give the default."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return default
    text = "\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect())
    try:
        return json.loads(text)
    except ValueError:
        return default


def write_json(spark: SparkSession, path: str, value) -> None:
    p, fs = _path(spark, path)
    out = fs.create(p, True)
    try:
        out.write(json.dumps(value, ensure_ascii=False, indent=2).encode())
    finally:
        out.close()


def signature(files: DataFrame) -> DataFrame:
    """``path, size, mtime``; contents are not read."""
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def manifest_delta(now: DataFrame, manifest: DataFrame, parse_tag: str) -> DataFrame:
    """What became of each file, of now and of the manifest (``path, size, mtime, parse_tag``): same, changed, new or gone."""
    old = manifest.select("path", F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"), F.col("parse_tag").alias("old_tag"))
    both = now.join(old, "path", "full_outer")
    same = (F.col("size") == F.col("old_size")) & (F.col("mtime") == F.col("old_mtime")) & (F.col("old_tag") == parse_tag)
    return both.select("path", F.when(F.col("size").isNull(), "gone").when(F.col("old_size").isNull(), "new").when(same, "same").otherwise("changed").alias("state"))


def to_parse(files: DataFrame, manifest: DataFrame, parse_tag: str) -> DataFrame:
    """Files with a content that no entry of this parse tag has: only those whose size or time changed are read and hashed."""
    touched = manifest_delta(signature(files), manifest, parse_tag).where(F.col("state").isin("new", "changed")).select("path")
    hashed = files.join(touched, "path", "left_semi").withColumn("sha256", F.sha2("content", 256))
    return hashed.join(manifest.where(F.col("parse_tag") == parse_tag).select("sha256").distinct(), "sha256", "left_anti")


def entries(files: DataFrame, parse_tag: str) -> DataFrame:
    """Manifest rows of parsed files (``path, sha256, length, modificationTime`` and maybe rows and error)."""
    have = set(files.columns)
    rows = F.col("rows") if "rows" in have else F.lit(None).cast("bigint")
    error = F.col("error") if "error" in have else F.lit(None).cast("string")
    return files.select("path", "sha256", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.lit(parse_tag).alias("parse_tag"), rows.alias("rows"), error.alias("error")).to(schemas.MANIFEST)


def rebuilt(spark: SparkSession, state_path: str, key: str, build) -> bool:
    """Runs ``build`` unless the state already names this key."""
    if read_json(spark, state_path, {}).get("key") == key:
        return False
    build()
    write_json(spark, state_path, {"key": key})
    return True


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def publish(df: DataFrame, home: str, name: str, key: str) -> DataFrame:
    """Writes a new version of a table, then points to it: a run that dies before leaves the old version in place.

    The version before stays for those who still read it; the one before that goes.
    """
    spark, pointer = df.sparkSession, f"{home}/{name}.json"
    before = read_json(spark, pointer, {})
    path = f"{home}/{name}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    write_json(spark, pointer, {"key": key, "path": path, "before": before.get("path"), "updated_at": dt.datetime.now(dt.UTC).isoformat()})
    if before.get("before"):
        remove(spark, before["before"])
    return spark.read.schema(df.schema).parquet(path)


def current(spark: SparkSession, home: str, name: str, key: str | None = None) -> DataFrame | None:
    """The published version of a table, if there is one (and it was built under ``key``)."""
    at = read_json(spark, f"{home}/{name}.json", {})
    if not at.get("path") or (key is not None and at.get("key") != key) or not exists(spark, at["path"]):
        return None
    return spark.read.parquet(at["path"])


def reused(spark: SparkSession, home: str, name: str, key: str, build) -> tuple[DataFrame, bool]:
    """The table of this key, and whether it was there already; ``build`` makes it if not."""
    found = current(spark, home, name, key)
    return (publish(build(), home, name, key), False) if found is None else (found, True)
