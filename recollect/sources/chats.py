"""Chat exports to messages: zipped text logs and question-and-answer CSV files.

Python only unpacks archives; lines, merging, times and filters are columns.
"""

from __future__ import annotations

import csv
import io
import itertools
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect import config, schemas

# What a message's first line looks like, date and time, sender, text.
START_PATTERNS = (
    r"^(\d{1,2}/\d{1,2}/\d{2,4}), (\d{1,2}:\d{2}) - ([^:]+): (.*)$",
    r"^\[(\d{1,2}/\d{1,2}/\d{2,4}), (\d{1,2}:\d{2}(?:\s?[ap]\.?m\.?))\] ([^:]+): (.*)$",
)
#: Line ends as Python's splitlines knows them.
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"
TIME_PATTERNS = ("d/M/yyyy H:mm", "d/M/yy H:mm", "d/M/yyyy h:mm a", "d/M/yy h:mm a")


def export_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path, modificationTime, length, content`` of the exports in a folder, or of the given ones; unread columns are not loaded."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{zip,csv,ZIP,CSV}").load(path)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def unzipped(files: DataFrame) -> DataFrame:
    """``path, content, error``: the first ``.txt`` member of each archive. A bad archive is an error in its row, not of the job."""

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        names = [n for n in z.namelist() if n.lower().endswith(".txt")]
                        rows.append((path, z.read(names[0]) if names else None, None if names else "no text member"))
                except (zipfile.BadZipFile, RuntimeError, NotImplementedError, EOFError, OSError) as e:
                    rows.append((path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "content", "error"])

    return files.where(F.lower("path").endswith(".zip")).select("path", "content").mapInPandas(unzip, "path string, content binary, error string")


def decoded(content: Column) -> Column:
    """UTF-8, or Latin-1 where the bytes are no UTF-8."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def lines(texts: DataFrame, key: str = "path", text_col: str = "text") -> DataFrame:
    """``key, line_no, line`` without byte order marks; a last line end opens no line."""
    t = F.regexp_replace(F.col(text_col), f"(?:{LINE_END})\\z", "")
    return texts.select(key, F.posexplode(F.split(t, LINE_END, -1)).alias("line_no", "line")).withColumn("line", F.regexp_replace("line", "^﻿+|﻿+$", ""))


def timestamp(date: Column, time: Column) -> Column:
    """Day first; 12-hour times may write am and pm in any of the usual ways. What cannot be read is null."""
    t = F.regexp_replace(F.regexp_replace(F.lower(time), r"\s*([ap])\.?m\.?$", " $1m"), "m$", "M")
    text = F.concat_ws(" ", date, F.upper(t))
    return F.coalesce(*(F.try_to_timestamp(F.when(text.rlike(r"/\d{4} " if "yyyy" in p else r"/\d{2} "), text), F.lit(p)) for p in TIME_PATTERNS)).cast("timestamp_ntz")


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def parse_lines(rows: DataFrame, key: str = "path", patterns: tuple[str, ...] = START_PATTERNS, split_system_lines: bool = False) -> DataFrame:
    """Messages from ``key, line_no, line``: a line that begins none continues the one before it, lines before the first are dropped.

    A notice without sender is glued to the message before it, which the
    system filter then drops; ``split_system_lines`` drops the notice instead.
    """
    line = F.col("line")
    which = F.coalesce(*(F.when(line.rlike(p), F.lit(i)) for i, p in enumerate(patterns)))
    part = lambda g: F.coalesce(*(F.when(F.col("which") == i, F.regexp_extract(line, p, g)) for i, p in enumerate(patterns)))
    if split_system_lines:
        rows = rows.where(~(which.isNull() & _system(line)))
    w = Window.partitionBy(key).orderBy("line_no")
    marked = rows.withColumn("which", which).withColumn("message", F.count("which").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("message > 0")
    piece = F.when(F.col("which").isNotNull(), _strip(part(4))).otherwise(_strip(line))
    merged = marked.groupBy(key, "message").agg(F.min("line_no").alias("seq"), F.max(F.when(F.col("which").isNotNull(), F.struct(part(1).alias("date"), part(2).alias("time"), _strip(part(3)).alias("sender")))).alias("head"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", piece.alias("piece")))), lambda x: x["piece"]), " ").alias("text"))
    out = merged.select(timestamp(F.col("head.date"), F.col("head.time")).alias("timestamp"), F.col("head.sender").alias("sender"), "text", stem(F.col(key)).alias("chat_name"), F.col(key).alias("source_file"), F.col("seq").cast("long").alias("seq"))
    return out.where(F.col("timestamp").isNotNull() & ~_system(F.col("text"))).withColumn("text", _plain_spaces(F.col("text")))


def _system(text: Column) -> Column:
    return F.lower(text).rlike("|".join(config.SYSTEM_SNIPPETS))


def _plain_spaces(text: Column) -> Column:
    return F.translate(text, " ", " ")


def zip_messages(files: DataFrame) -> DataFrame:
    texts = unzipped(files).where("content IS NOT NULL").select("path", decoded(F.col("content")).alias("text"))
    return parse_lines(lines(texts))


CSV_COLUMNS = ("contact", "question", "question_dt", "answer_dt")


def csv_rows(files: DataFrame, answer_col: str = "owner_answer") -> DataFrame:
    """``path, row_no, error`` and the known columns of all CSV files in one plan; empty cells are null. A bad file is an error in its row, not of the job."""
    wanted = [*CSV_COLUMNS, answer_col]
    names = ["path", "row_no", *wanted, "error"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                error = None
                try:
                    rows = csv.DictReader(io.StringIO(content.decode("utf-8-sig"), newline=""))
                    if {"question", answer_col} <= set(rows.fieldnames or ()):
                        numbered = ((path, i, *(r.get(c) or None for c in wanted), None) for i, r in enumerate(rows))
                        while part := list(itertools.islice(numbered, 4096)):
                            yield pd.DataFrame(part, columns=names)
                    else:
                        error = f"no columns question and {answer_col}"
                except (UnicodeDecodeError, csv.Error) as e:
                    error = f"{type(e).__name__}: {e}"
                if error:
                    yield pd.DataFrame([(path, None, *[None] * len(wanted), error)], columns=names)

    schema = ", ".join(["path string", "row_no long", *(f"`{c}` string" for c in wanted), "error string"])
    return files.where(F.lower("path").endswith(".csv")).select("path", "content").mapInPandas(read, schema)


def csv_messages(rows: DataFrame, owner: str, source: str | Column = "csv", question_col: str = "question", answer_col: str = "owner_answer") -> DataFrame:
    """Up to two messages of each row; rows without a readable date are dropped. Without the two required columns the result is empty."""
    spark = rows.sparkSession
    if not {question_col, answer_col} <= set(rows.columns):
        return spark.createDataFrame([], schemas.MESSAGES)
    column = lambda c: F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string")
    contact = F.coalesce(column("contact"), F.lit("Contacto"))
    when = lambda c: F.coalesce(F.try_to_timestamp(column(c)).cast("timestamp_ntz"), timestamp(F.split(column(c), " ")[0], F.regexp_replace(column(c), r"^\S+\s+", "")))
    chat = F.concat(F.lit("Chat CSV con "), contact)
    message = lambda ts, who, text, n: F.struct(ts.alias("timestamp"), who.alias("sender"), _strip(F.coalesce(text, F.lit(""))).alias("text"), F.lit(n).alias("n"))
    both = F.array(message(when("question_dt"), contact, column(question_col), 0), message(when("answer_dt"), F.lit(owner), column(answer_col), 1))
    seq = F.col("row_no") if "row_no" in rows.columns else F.monotonically_increasing_id()
    file = source if isinstance(source, Column) else F.lit(source)
    out = rows.select(chat.alias("chat_name"), file.alias("source_file"), seq.alias("row"), F.explode(both).alias("m"))
    out = out.select("m.timestamp", "m.sender", _plain_spaces(F.col("m.text")).alias("text"), "chat_name", "source_file", (F.col("row") * 2 + F.col("m.n")).cast("long").alias("seq"))
    return out.where("timestamp IS NOT NULL AND text <> ''")


def file_messages(files: DataFrame, owner: str, answer_col: str = "owner_answer") -> DataFrame:
    """Messages of all exports (``path, content``), whatever their number, in one plan with a branch a format."""
    rows = csv_rows(files, answer_col).where("error IS NULL")
    return zip_messages(files).unionByName(csv_messages(rows, owner, F.col("path"), answer_col=answer_col))


def failures(files: DataFrame, answer_col: str = "owner_answer") -> DataFrame:
    """``path, error`` of the exports that cannot be read."""
    bad = unzipped(files).select("path", "error").unionByName(csv_rows(files, answer_col).select("path", "error"))
    return bad.where("error IS NOT NULL").groupBy("path").agg(F.min("error").alias("error"))


def messages(spark: SparkSession, path: str, owner: str, answer_col: str = "owner_answer") -> DataFrame:
    """All exports of a folder."""
    return file_messages(export_files(spark, path), owner, answer_col)
