"""Scans for leaked credentials: texts, notebooks and paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels and patterns, blocked names and endings.
PATTERNS = {
    "llm vendor key": r"sk-(?:proj|live|test)-[A-Za-z0-9_-]{20,}",
    "code host token": r"gh[pousr]_[A-Za-z0-9]{20,}",
    "cloud access key": r"AKIA[0-9A-Z]{16}",
    "cloud secret assignment": r"(?i)aws_secret_access_key\s*[:=]\s*[A-Za-z0-9/+_=]{30,}",
    "private key": r"-----BEGIN (?:RSA|OPENSSH|EC|DSA|PGP) PRIVATE KEY-----",
}
BLOCKED_NAMES = ("AGENTS.md", "agents.md")
ALLOWED_ENV = ".env.example"
BLOCKED_SUFFIXES = (".pem", ".key", ".p12", ".crt")


def _newlines(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def matches(text: Column, pattern: str) -> Column:
    """Array of (match, line from 1) of all non-overlapping matches, from the pieces between them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    step = lambda acc, i: F.struct((acc["line"] + _newlines(F.element_at(pieces, i))).alias("line"), acc["out"].alias("out"))
    start = F.struct(F.lit(1).alias("line"), F.array().cast("array<struct<match:string,line:int>>").alias("out"))

    def add(acc: Column, i: Column) -> Column:
        at = step(acc, i)["line"]
        m = F.element_at(found, i)
        return F.struct((at + _newlines(m)).cast("int").alias("line"), F.concat(acc["out"], F.array(F.struct(m.alias("match"), at.cast("int").alias("line")))).alias("out"))

    return F.when(F.size(found) > 0, F.aggregate(F.sequence(F.lit(1), F.size(found)), start, add, lambda acc: acc["out"])).otherwise(F.array().cast("array<struct<match:string,line:int>>"))


def scan_text(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """``key, label, line, match``; texts without any match leave at the first, combined test."""
    some = reduce(lambda a, b: a | b, (F.col(text_col).rlike(p) for p in PATTERNS.values()))

    def labelled(label: str) -> Column:
        return F.transform(matches(F.col(text_col), PATTERNS[label]), lambda m: F.struct(F.lit(label).alias("label"), m["line"].alias("line"), m["match"].alias("match")))

    found = F.flatten(F.array(*map(labelled, PATTERNS)))
    return df.where(some).select(F.col(key), F.explode(found).alias("f")).select(key, "f.label", "f.line", "f.match")


def blocked_path(path: Column) -> Column:
    """Why a path must not be in a repository: an array of reasons, empty if it may. Only the exact ``ALLOWED_ENV`` is exempt; a leading dot starts no suffix."""
    name = F.coalesce(F.element_at(F.split(path, "/"), -1), F.lit(""))
    low = F.lower(name)
    env = low.startswith(".env") & (name != ALLOWED_ENV)
    suffix = reduce(lambda a, b: a | b, (low.endswith(x) & (F.length(low) > len(x)) for x in BLOCKED_SUFFIXES))
    reasons = ((name.isin(*BLOCKED_NAMES), "blocked name"), (env, "environment file"), (suffix, "blocked suffix"))
    return F.array_compact(F.array(*(F.when(c, r) for c, r in reasons)))


_NOTEBOOK = "cells array<struct<cell_type:string,source:string,outputs:array<string>>>"


def scan_notebooks(df: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """Parse failures, code cells with outputs, and credentials in cell sources. Cells count from 1; the raw file is not scanned."""
    nb = F.from_json(F.col(text_col), _NOTEBOOK, {"mode": "PERMISSIVE"})
    parsed = df.select(F.col(path_col).alias("path"), F.try_parse_json(F.col(text_col)).isNull().alias("broken"), nb.alias("nb"))
    none = lambda t: F.lit(None).cast(t)
    broken = parsed.where("broken").select("path", none("int").alias("cell"), none("int").alias("line"), F.lit("invalid notebook").alias("label"), F.lit("parse").alias("kind"))
    cells = parsed.where("NOT broken").select("path", F.posexplode(F.coalesce(F.col("nb.cells"), F.array().cast("array<struct<cell_type:string,source:string,outputs:array<string>>>"))).alias("pos", "c"))
    cells = cells.select("path", (F.col("pos") + 1).alias("cell"), F.col("c.cell_type").alias("cell_type"), F.size(F.coalesce("c.outputs", F.array().cast("array<string>"))).alias("outputs"), F.coalesce(F.array_join(F.from_json("c.source", "array<string>"), ""), F.col("c.source"), F.lit("")).alias("source"))
    shown = cells.where("cell_type = 'code' AND outputs > 0").select("path", "cell", none("int").alias("line"), F.lit("cell has outputs").alias("label"), F.lit("outputs").alias("kind"))
    keyed = cells.withColumn("key", F.struct("path", "cell"))
    secrets = scan_text(keyed, "key", "source").select("key.path", "key.cell", "line", "label", F.lit("secret").alias("kind"))
    return broken.unionByName(shown).unionByName(secrets)


def scan_files(files: DataFrame) -> DataFrame:
    """Findings over ``path, content``: path rules first; notebooks by cell, where bytes that are no UTF-8 or hold NUL are a parse failure; other files as text unless they hold a NUL byte."""
    none = F.lit(None).cast("int")
    bad = files.select("path", F.explode(blocked_path(F.col("path"))).alias("label")).select("path", none.alias("cell"), none.alias("line"), "label", F.lit("path").alias("kind"))
    notebook = F.lower("path").endswith(".ipynb")
    whole = F.col("content").cast("string")
    cells = files.where(notebook).select("path", F.when(F.is_valid_utf8(whole) & (F.position(F.lit(b"\0"), F.col("content")) == 0), whole).alias("text"))
    text = files.where(~notebook & (F.position(F.lit(b"\0"), F.col("content")) == 0)).withColumn("text", F.regexp_replace(F.decode(F.try_validate_utf8(F.make_valid_utf8(F.col("content").cast("string"))).cast("binary"), "UTF-8"), "�", ""))
    plain = scan_text(text, "path", "text").select("path", none.alias("cell"), "line", "label", F.lit("secret").alias("kind"))
    return bad.unionByName(plain).unionByName(scan_notebooks(cells, "path", "text"))


def exit_code(findings: DataFrame) -> int:
    return int(not findings.isEmpty())
