"""The engine end to end: exports to messages, units, vectors and clusters. Each step is redone only if what it reads has changed.

Everything lies in one folder that driver and executors share. Tables are
versions behind a pointer (``state.publish``), so a run that dies at any point
leaves what was there and the next one goes on from it.
"""

from __future__ import annotations

import re
import time
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from recollect import schemas
from recollect.config import Settings
from recollect.operators import embed, messages, units
from recollect.sources import chats, state

#: Change them when what the steps give for the same input changes.
PARSER, CLUSTERS = "1", "1"
_CACHED = StructType([*schemas.MESSAGES.fields, StructField("batch", StringType())])


@dataclass
class Report:
    """Counts and seconds by step, and which tables were there already."""

    counts: dict[str, int] = field(default_factory=dict)
    seconds: dict[str, float] = field(default_factory=dict)
    reused: dict[str, bool] = field(default_factory=dict)


def _these(spark: SparkSession, paths: list[str]) -> DataFrame:
    return chats.export_files(spark, [re.sub(r"([\\*?\[\]{}])", r"\\\1", p) for p in paths])


def manifest(spark: SparkSession, home: str) -> DataFrame:
    found = state.current(spark, home, "manifest")
    return spark.createDataFrame([], schemas.MANIFEST) if found is None else found


def _key(entries: DataFrame) -> str:
    """Names a manifest by its contents, in whatever order they lie."""
    h = F.xxhash64("path", "sha256", "parse_tag", F.coalesce("error", F.lit("")))
    r = entries.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s")).first()
    return f"{r['n']}-{r['x']}-{r['s']}"


def ingest(spark: SparkSession, inbox: str, home: str, owner: str, report: Report, answer_col: str = "owner_answer") -> tuple[DataFrame, str]:
    """Messages of a folder's exports, and the key of what they were read from.

    Files of unchanged size and time are not read; of the others only those
    whose bytes changed are parsed, into a batch of the cache. An unreadable
    file is an entry with an error and is tried again the next time; entries of
    files that are gone go, and batches without entries with them. The owner
    is part of the parse tag, as CSV answers carry that name.
    """
    run, tag = uuid.uuid4().hex, f"{PARSER}|owner={owner.strip()}|answer={answer_col}"
    known = manifest(spark, home)
    good = known.where("error IS NULL")
    delta = state.manifest_delta(state.signature(chats.export_files(spark, inbox)), good, tag).cache()
    by_state = {r["state"]: r["count"] for r in delta.groupBy("state").count().collect()}
    # paths only, which the driver lists anyway
    touched = [r[0] for r in delta.where(F.col("state").isin("new", "changed")).select("path").collect()]
    kept = good.join(delta.where("state = 'same'").select("path"), "path", "left_semi")
    delta_is_empty = not touched and not by_state.get("gone")
    hits = parsed = failed = 0
    if touched:
        old = good.where(F.col("parse_tag") == tag).select("path", "sha256", "rows", "batch")
        hashed = _these(spark, touched).select("path", F.sha2("content", 256).alias("sha256"), "length", "modificationTime")
        seen = state.entries(hashed, tag).drop("rows", "error", "batch").join(old, ["path", "sha256"], "left").cache()
        todo = [r[0] for r in seen.where("batch IS NULL").select("path").collect()]
        kept = kept.unionByName(seen.where("batch IS NOT NULL").withColumn("error", F.lit(None).cast("string")))
        hits = len(touched) - len(todo)
        if todo:
            files = _these(spark, todo)
            chats.file_messages(files, owner, answer_col).write.parquet(f"{home}/ingest_cache/batch={run}")
            rows = _cache(spark, home).where(F.col("batch") == run).groupBy(F.col("source_file").alias("path")).agg(F.count("*").alias("n"))
            new = seen.where("batch IS NULL").drop("rows", "batch").join(rows, "path", "left").join(chats.failures(files, answer_col), "path", "left")
            new = new.withColumn("rows", F.when(F.col("error").isNull(), F.coalesce("n", F.lit(0)))).drop("n").withColumn("batch", F.lit(run)).cache()
            failed = new.where("error IS NOT NULL").count()
            parsed = len(todo) - failed
            kept = kept.unionByName(new)
    if delta_is_empty:
        entries = known
    else:
        entries = state.publish(kept.to(schemas.MANIFEST), home, "manifest", run)
    live = entries.where("error IS NULL")
    key = _key(entries)
    cached = _cache(spark, home).join(live.select("batch", F.col("path").alias("source_file")), ["batch", "source_file"], "left_semi").drop("batch")
    order = ("chat_name", "timestamp", "seq")
    out, report.reused["messages"] = state.reused(spark, home, "messages", key, lambda: cached.repartitionByRange(*order).sortWithinPartitions(*order))
    if not delta_is_empty:
        names = lambda df: {r[0] for r in df.select("batch").distinct().collect() if r[0]}
        for batch in names(known) - names(live):
            state.remove(spark, f"{home}/ingest_cache/batch={batch}")
    report.counts |= {"fast": by_state.get("same", 0), "hash": hits, "parsed": parsed, "failed": failed, "gone": by_state.get("gone", 0)}
    return out, key


def _cache(spark: SparkSession, home: str) -> DataFrame:
    return state.read_table(spark, f"{home}/ingest_cache", _CACHED)


def units_of(spark: SparkSession, home: str, raw: DataFrame, key: str, s: Settings, report: Report) -> dict[str, DataFrame]:
    """Clean messages, memory units and the two kinds of units that are searched, under the settings' key."""
    named = messages.with_sender(raw)
    owner, report.counts["owner_found"] = (found := messages.resolve_owner(named, s.owner))[0], found[1]
    s = replace(s, owner=owner)
    fingerprint = "|".join(map(str, messages.fingerprint(raw).first()))
    key = s.key(key, fingerprint)
    out: dict[str, DataFrame] = {}

    def step(name: str, build) -> None:
        out[name], report.reused[name] = state.reused(spark, home, name, key, build)

    step("messages_clean", lambda: messages.first_of_duplicates(messages.with_labels(messages.with_owner(named, owner))))
    step("memory_units", lambda: units.memory_units(out["messages_clean"], s).repartitionByRange("timestamp", "source_id").sortWithinPartitions("timestamp", "source_id"))
    step("response_units", lambda: units.response_units(out["memory_units"], s))
    step("style_units", lambda: units.style_units(out["memory_units"], s))
    return out


def index(spark: SparkSession, home: str, role: str, of: DataFrame, encoder: embed.Encoder, report: Report, version: str = "1") -> DataFrame:
    """Units with vectors; those of the version before are used again where their hash is the same."""
    name, text = f"{role}_index", f"{role}_embed_text"
    hashed = embed.with_unit_hash(of, text, f"{version}|{encoder.name}")
    key = embed.hash_of_hashes(hashed, "unit_hash", version).first()["key"] or "empty"
    before = state.current(spark, home, name)
    cache = spark.createDataFrame([], "unit_hash string, embedding array<float>") if before is None else before.select("unit_hash", "embedding").dropDuplicates(["unit_hash"])
    out, report.reused[name] = state.reused(spark, home, name, key, lambda: embed.embed_incrementally(hashed, cache, text, encoder))
    return out


def clustered(spark: SparkSession, home: str, style: DataFrame, report: Report) -> DataFrame:
    """Style units with their cluster; clusters are kept by unit hash, under the key of all hashes."""
    key = embed.hash_of_hashes(style, "unit_hash", CLUSTERS).first()["key"] or "empty"
    build = lambda: embed.kmeans_labels(style).select("unit_hash", "style_cluster").dropDuplicates(["unit_hash"])
    labels, report.reused["style_clusters"] = state.reused(spark, home, "style_clusters", key, build)
    return style.join(labels, "unit_hash")


def run(spark: SparkSession, inbox: str, home: str, encoder: embed.Encoder, settings: Settings = Settings(), answer_col: str = "owner_answer") -> tuple[DataFrame, DataFrame, Report]:
    """Response units and style units, ready for ``search.ask``, and what had to be done for them."""
    report = Report()
    begun = time.perf_counter()

    def lap(name: str) -> None:
        report.seconds[name] = round(time.perf_counter() - begun - sum(report.seconds.values()), 3)

    raw, key = ingest(spark, inbox, home, settings.owner, report, answer_col)
    lap("ingest")
    tables = units_of(spark, home, raw, key, settings, report)
    lap("units")
    response = index(spark, home, "response", tables["response_units"], encoder, report)
    style = clustered(spark, home, index(spark, home, "style", tables["style_units"], encoder, report), report)
    lap("vectors")
    return response, style, report
