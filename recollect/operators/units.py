"""Memory units from ordered messages: reply turns, own messages, topic blocks.

All three read the same partitioning and order (chat; time, seq). Each kind
still plans its own exchange; equal ones are shared only where the planner
finds them equal.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect import config, schemas
from recollect.config import Settings
from recollect.functions import text as fn


def _chat():
    return Window.partitionBy("chat_name").orderBy("timestamp", "seq")


def _said() -> Column:
    return F.concat(F.coalesce("sender", F.lit("")), F.lit(": "), F.coalesce("text", F.lit("")))


def _lines(frame) -> Column:
    return F.array_join(F.collect_list(_said()).over(frame), "\n")


def _unit(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.MEMORY_UNITS))


def _other(frame) -> Column:
    """The last message of another sender in the frame."""
    return F.last(F.when(~F.col("is_me"), F.struct("timestamp", "sender", "text")), ignorenulls=True).over(frame)


def qa_turns(messages: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The owner's replies with the rows before them. Filters come after the windows: low-signal rows are context, too."""
    frame = _chat().rowsBetween(-s.context_rows, -1)
    asked = F.coalesce(F.max(F.col("is_question") & ~F.col("is_me")).over(_chat().rowsBetween(-min(4, s.context_rows), -1)), F.lit(False))
    rows = messages.withColumns({"pos": F.row_number().over(_chat()) - 1, "context": _lines(frame), "other": _other(frame), "asked": asked})
    gap = (F.unix_micros(F.col("timestamp").cast("timestamp")) - F.unix_micros(F.col("other.timestamp").cast("timestamp"))) / 6e7
    keep = F.col("is_me") & ~F.col("is_low_signal") & (F.col("pos") > 0) & (F.col("gap").isNull() | (F.col("gap") <= s.reply_gap_minutes))
    keep = keep & F.col("other").isNotNull() if s.require_other else keep
    keep = keep & F.col("asked") if s.require_question else keep
    rows = rows.withColumn("gap", gap).where(keep)
    partner = F.coalesce(F.col("other.text"), F.lit(""))
    return _unit(rows.select("chat_name", "timestamp", "context", "signal_score", "self_fact", F.lit("qa_turn").alias("unit_type"), partner.alias("partner_text"), F.coalesce(F.col("other.sender"), F.lit("")).alias("partner_sender"), F.col("gap").alias("reply_gap_min"), F.col("text").alias("response"), F.col("text").alias("style_text"), fn.style_signature(F.col("text")).alias("style_signature"), fn.filled(config.QA_TEXT, partner, F.col("context"), F.col("text")).alias("embed_text"), F.concat(F.lit("qa::"), "chat_name", F.lit("::"), F.col("pos")).alias("source_id")))


def own_messages(messages: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The owner's messages with the rows around them, themselves included."""
    rows = messages.withColumns({"pos": F.row_number().over(_chat()) - 1, "context": _lines(_chat().rowsBetween(-s.own_window, s.own_window)), "other": _other(_chat().rowsBetween(Window.unboundedPreceding, -1))})
    rows = rows.where("is_me AND NOT is_low_signal")
    partner = F.coalesce(F.col("other.text"), F.lit(""))
    return _unit(rows.select("chat_name", "timestamp", "context", "signal_score", "self_fact", F.lit("my_message").alias("unit_type"), partner.alias("partner_text"), F.coalesce(F.col("other.sender"), F.lit("")).alias("partner_sender"), F.lit(None).alias("reply_gap_min"), F.col("text").alias("response"), F.col("text").alias("style_text"), fn.style_signature(F.col("text")).alias("style_signature"), fn.filled(config.MESSAGE_TEXT, partner, F.col("text"), F.col("context")).alias("embed_text"), F.concat(F.lit("msg::"), "chat_name", F.lit("::"), F.col("pos")).alias("source_id")))


def with_topics(messages: DataFrame, gap_minutes: int) -> DataFrame:
    """Adds topic (from 0 in each chat): a pause longer than the gap begins a new one."""
    before = F.lag("timestamp").over(_chat())
    new = before.isNull() | (F.col("timestamp") - before > F.expr(f"INTERVAL '{gap_minutes}' MINUTE"))
    return messages.withColumn("new_topic", new.cast("int")).withColumn("topic", (F.sum("new_topic").over(_chat().rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int")).drop("new_topic")


def topic_blocks(messages: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Blocks of several sizes that start every few messages of a topic, up to the caps."""
    topic = Window.partitionBy("chat_name", "topic").orderBy("timestamp", "seq")
    rows = with_topics(messages, s.topic_gap_minutes).withColumns({"start": F.row_number().over(topic) - 1, "n": F.count("*").over(Window.partitionBy("chat_name", "topic"))})
    stride = reduce(lambda c, x: c.when(F.col("n") < x[0], x[1]), s.block_strides[1:], F.when(F.col("n") < s.block_strides[0][0], s.block_strides[0][1]))

    def frames(size: int) -> Column:
        w = topic.rowsBetween(0, size - 1)
        return F.struct(F.lit(size).alias("size"), F.avg("signal_score").over(w).alias("signal"), _lines(w).alias("lines"), F.max("self_fact").over(w).alias("fact"), F.last("timestamp").over(w).alias("ended"))

    blocks = rows.withColumn("block", F.array(*(frames(x) for x in s.block_sizes))).where(F.col("start") % stride == 0).select("chat_name", "topic", "start", "n", F.explode("block").alias("b"))
    blocks = blocks.where((F.col("start") + F.col("b.size") <= F.col("n")) & (F.col("b.signal") >= s.block_min_signal))
    rank = F.row_number().over(Window.partitionBy("chat_name", "topic").orderBy("start", "b.size"))
    return _unit(_first(blocks.withColumn("rank", rank).where(F.col("rank") <= s.blocks_per_topic), s.blocks_total).select("chat_name", F.lit("topic_block").alias("unit_type"), F.col("b.ended").alias("timestamp"), F.col("b.lines").alias("context"), F.lit("").alias("partner_text"), F.lit("").alias("partner_sender"), F.lit(None).alias("reply_gap_min"), F.lit("").alias("response"), F.lit("").alias("style_text"), F.lit("block").alias("style_signature"), F.col("b.signal").alias("signal_score"), F.col("b.fact").alias("self_fact"), fn.filled(config.BLOCK_TEXT, F.col("b.lines")).alias("embed_text"), F.concat_ws("::", F.lit("blk"), "chat_name", "topic", "start", F.col("start") + F.col("b.size")).alias("source_id")))


def _first(blocks: DataFrame, total: int) -> DataFrame:
    """The first blocks in order of chat, topic, start and size. Only one row a chat is brought together, to add up how many blocks come before."""
    chats = blocks.groupBy("chat_name").agg(F.count("*").alias("own"))
    before = chats.withColumn("before", F.sum("own").over(Window.orderBy("chat_name")) - F.col("own")).where(F.col("before") < total)
    rank = F.row_number().over(Window.partitionBy("chat_name").orderBy("topic", "start", "b.size"))
    return blocks.join(before, "chat_name").withColumn("in_chat", rank).where(F.col("before") + F.col("in_chat") <= total)


def memory_units(messages: DataFrame, s: Settings = Settings()) -> DataFrame:
    return qa_turns(messages, s).unionByName(own_messages(messages, s)).unionByName(topic_blocks(messages, s))


def response_units(units: DataFrame, s: Settings = Settings()) -> DataFrame:
    u = units.where("unit_type = 'qa_turn'").withColumns({c: F.trim(F.coalesce(c, F.lit(""))) for c in ("partner_text", "response")})
    u = u.where((F.length("partner_text") >= 1) & (F.length("response") >= s.min_response_chars))
    return u.withColumns({"response_embed_text": fn.filled(config.RESPONSE_TEXT, F.col("partner_text"), F.col("context"), F.col("response")), "retrieval_role": F.lit("response")})


def style_units(units: DataFrame, s: Settings = Settings()) -> DataFrame:
    u = units.where(F.col("unit_type").isin("qa_turn", "my_message")).withColumn("style_text", F.trim(F.coalesce("response", F.lit(""))))
    u = u.where((F.length("style_text") >= s.min_style_chars) & (fn.token_len(fn.collapse(F.col("style_text"))) <= s.max_style_words))
    return u.withColumns({"style_signature": fn.style_signature(F.col("style_text")), "style_embed_text": fn.filled(config.STYLE_TEXT, F.col("style_text"), F.col("context")), "retrieval_role": F.lit("style")})
