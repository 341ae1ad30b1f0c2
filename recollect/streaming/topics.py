"""Topics over a stream of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streamed_topics(messages: DataFrame, gap_minutes: int = 45, late_minutes: int = 60) -> DataFrame:
    """Session windows of each chat, closed once the watermark has passed them. A pause of exactly the gap stays in the topic.

    ``messages`` has chat_name and a ``timestamp``; it may be a stream or not.
    A session window's end is exclusive, hence the microsecond.
    """
    gap = f"{gap_minutes} minutes 1 microsecond"
    rows = messages.withColumn("ts", F.col("timestamp").cast("timestamp")).withWatermark("ts", f"{late_minutes} minutes")
    topics = rows.groupBy("chat_name", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.max("ts").alias("ended"))
    return topics.select("chat_name", F.col("w.start").alias("begun"), "ended", "n")
