"""Owner, labels and first-of-duplicates: raw messages to clean ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect import config
from recollect.functions import text as fn


def with_sender(messages: DataFrame, unicode: bool = True) -> DataFrame:
    named = messages.withColumn("sender", fn.sender_name(F.col("sender"), unicode))
    return named.withColumn("sender_key", fn.folded(F.col("sender")))


def sender_coverage(messages: DataFrame) -> DataFrame:
    """Distinct chats and messages of each sender."""
    return messages.where("sender_key <> ''").groupBy("sender_key").agg(F.countDistinct("chat_name").alias("chats"), F.count("*").alias("messages"))


def _spelling(messages: DataFrame) -> str:
    r = messages.groupBy("sender").count().orderBy(F.desc("count"), "sender").first()
    return r["sender"]


def resolve_owner(messages: DataFrame, configured: str) -> tuple[str, str]:
    """The owner's name and how it was found. Ties go to the name that comes first."""
    name = (configured or "").strip()
    key = name.casefold()
    named = key not in config.OWNER_PLACEHOLDERS
    if named and not (own := messages.where(F.col("sender_key") == key)).isEmpty():
        return _spelling(own), "config_match"
    top = sender_coverage(messages).orderBy(F.desc("chats"), "sender_key").first()
    if top is None:
        return name or config.Settings.owner, "fallback_default"
    total = messages.where("sender_key <> ''").agg(F.countDistinct("chat_name")).first()[0]
    if total >= 2 and top["chats"] >= max(2, total // 2):
        return _spelling(messages.where(F.col("sender_key") == top["sender_key"])), "inferred_chat_coverage"
    if named:
        return name, "config_no_match"
    return _spelling(messages.where("sender_key <> ''")), "inferred_top_count"


def with_owner(messages: DataFrame, owner: str) -> DataFrame:
    key = (owner or "").strip().casefold()
    return messages.withColumn("is_me", (F.col("sender_key") == key) & F.lit(bool(key)))


def owner_counts(messages: DataFrame) -> DataFrame:
    """One row: how many messages there are, and how many the owner's are."""
    return messages.agg(F.count("*").alias("n"), F.count_if("is_me").alias("own"))


def with_labels(messages: DataFrame, unicode: bool = True) -> DataFrame:
    """Needs ``is_me``. Messages whose text is empty once normalized are left out."""
    t = F.col("text")
    out = messages.withColumn("text_raw", t).withColumn("text", fn.normalized(t, unicode)).where(F.length("text") > 0)
    out = out.withColumns({"has_url": fn.has_url(t), "is_question": fn.is_question(t), "is_low_signal": fn.is_low_signal(t), "token_len": fn.token_len(t), "self_fact": F.col("is_me") & fn.is_self_fact(t)})
    return out.withColumn("signal_score", fn.signal_score(t, F.col("is_question"), F.col("has_url")))


def first_of_duplicates(messages: DataFrame) -> DataFrame:
    """Of equal (chat, time, sender, text) the row of the least seq."""
    w = Window.partitionBy("chat_name", "timestamp", "sender", "text").orderBy("seq")
    return messages.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def clean(messages: DataFrame, configured_owner: str) -> DataFrame:
    named = with_sender(messages)
    owner, _ = resolve_owner(named, configured_owner)
    return first_of_duplicates(with_labels(with_owner(named, owner)))


def fingerprint(messages: DataFrame) -> DataFrame:
    """One row that changes whenever any message does, in whatever order they lie."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("timestamp", "sender", "text", "chat_name")]
    return messages.agg(F.count("*").alias("n"), F.min("timestamp").alias("ts_min"), F.max("timestamp").alias("ts_max"), F.bit_xor(F.xxhash64(*cols)).alias("x"), F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).alias("s"))
