"""Engine tables made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.operators import messages as msg


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as messages, with pauses, questions, addresses and acknowledgements added by rule."""
    base = F.trim(F.regexp_replace("text", r"\s+", " "))
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("conv_"), "conv_id").alias("chat_name"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(conv_id AS int), 0, cast(turn*15*(1+conv_id%4) + CASE WHEN conv_id%3=0 THEN 0 ELSE 50*(turn div 3) END AS int), 0)").alias("timestamp"),
        F.col("turn").alias("seq"),
        F.col("role").alias("sender"),
        F.when(F.expr("(conv_id+turn)%11=0"), F.lit("ok")).otherwise(F.concat(base, F.when(F.expr("turn%4=0"), "?").otherwise(""), F.when(F.expr("conv_id%5=0 AND turn%3=1"), " https://ex.test/a").otherwise(""))).alias("text"),
    )


def clean_conversations(spark: SparkSession, sf_dir: str, owner: str = "assistant") -> DataFrame:
    raw = msg.with_owner(msg.with_sender(conversation_messages(spark, sf_dir)), owner)
    return msg.first_of_duplicates(msg.with_labels(raw))


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as messages: purchases are the owner's."""
    return table(spark, sf_dir, "events").select(F.concat(F.lit("user_"), "user_id").alias("chat_name"), F.col("ts").alias("timestamp"), F.col("event_id").alias("seq"), F.col("event_type").alias("sender"), F.concat("event_type", F.lit(" "), "props").alias("text"))


def clean_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return msg.with_labels(msg.with_owner(msg.with_sender(event_messages(spark, sf_dir)), "purchase"))


def vector_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, v = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "events")
    return e.join(v, e.vec_id == v.event_id).select("vec_id", "embedding", F.expr("concat('u', vec_id%400)").alias("source_id"), F.col("ts").alias("timestamp"), F.concat(F.lit("user_"), "user_id").alias("chat_name"), F.expr("CASE WHEN vec_id%10=0 THEN 0D ELSE (vec_id%100)/100D END").alias("signal_score"), F.expr("CASE WHEN vec_id%7=0 THEN NULL ELSE value END").alias("reply_gap_min"), F.col("label").alias("style_cluster"), F.expr("concat('cluster ', label, ' text ', vec_id%37)").alias("style_text"))


def query_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50, as the query set of the searches."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
