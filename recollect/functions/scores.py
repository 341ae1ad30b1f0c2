"""Features that rerank search hits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def recency(ts: Column, newest: Column, alpha: float) -> Column:
    """Falls by a thousandth for each whole elapsed day, not calendar day."""
    days = F.greatest(F.floor((F.unix_micros(newest.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 86_400_000_000), F.lit(0))
    return F.when(ts.isNull() | newest.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.lit(alpha) - days * 0.001))


def gap_bonus(minutes: Column) -> Column:
    return F.when(minutes.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), 0.03 - F.least(minutes, F.lit(120.0)) * 0.00025))


def length_bonus(words: Column) -> Column:
    return F.least(F.lit(0.04), words / 400.0)


def signal_or_default(signal: Column, default: float) -> Column:
    """A signal of 0 counts as none."""
    return F.when(signal.isNull() | (signal == 0), F.lit(default)).otherwise(signal)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
