"""Explicit schemas of the engine's tables."""

from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "timestamp_ntz": T.TimestampNTZType()}


def _schema(text: str) -> T.StructType:
    """From ``name type, ...``, without a session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (x.split() for x in text.split(","))])


MESSAGES = _schema("timestamp timestamp_ntz, sender string, text string, chat_name string, source_file string, seq bigint")
MESSAGES_CLEAN = _schema("timestamp timestamp_ntz, sender string, text string, chat_name string, seq bigint, sender_key string, is_me boolean, text_raw string, has_url boolean, is_question boolean, is_low_signal boolean, signal_score double, token_len int, self_fact boolean")
MEMORY_UNITS = _schema("unit_type string, chat_name string, timestamp timestamp_ntz, context string, partner_text string, partner_sender string, reply_gap_min double, response string, style_text string, style_signature string, signal_score double, self_fact boolean, embed_text string, source_id string")
MANIFEST = _schema("path string, sha256 string, size bigint, mtime timestamp, parse_tag string, rows bigint, error string, batch string")
FINDINGS = _schema("path string, cell int, line int, label string, kind string")
