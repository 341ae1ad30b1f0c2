"""Text functions as column expressions; Python gets only texts whose letters are too new for Java, in Arrow batches."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from recollect import config


def _form(t: Column, step: str, python=None) -> Column:
    """A compatibility form by Spark's own ICU, in the JVM. With ``python``, texts with letters that Java has no tables of go there instead.

    Spark takes the call as nondeterministic, so no filter on the result is pushed below it, where it would be evaluated a second time.
    """
    icu = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit(step), t, F.lit(True))
    if python is None:
        return F.when(t.isNotNull(), icu)
    newer = t.rlike(r"\p{Cn}")
    return F.when(newer, python(F.when(newer, t))).when(t.isNotNull(), icu)


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x))


_nfkc = _nfkc.asNondeterministic()  # as above


def nfkc(t: Column) -> Column:
    return _form(t, "compose", _nfkc)


def collapse(t: Column) -> Column:
    """Runs of Unicode white space become one space; none is left at the ends."""
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def normalized(t: Column, unicode: bool = True) -> Column:
    t = F.coalesce(t.cast("string"), F.lit(""))
    return collapse(F.translate(nfkc(t) if unicode else t, "​﻿", ""))


def sender_name(t: Column, unicode: bool = True) -> Column:
    t = F.coalesce(t.cast("string"), F.lit(""))
    return F.regexp_replace(_form(t, "compose") if unicode else t, r"(?U)^\s+|\s+$", "")


def folded(t: Column) -> Column:
    """Case folding, sharp s included."""
    return F.lower(F.upper(t))


def has_url(t: Column) -> Column:
    return F.coalesce(t, F.lit("")).rlike(r"(?i)(https?://|www\.)")


def _bare(t: Column) -> Column:
    return F.lower(F.trim(F.coalesce(t, F.lit(""))))


def is_question(t: Column) -> Column:
    b = _bare(t)
    return F.contains(b, F.lit("?")) | b.rlike("^(" + "|".join(config.QUESTION_PREFIXES) + ") ")


def is_low_signal(t: Column) -> Column:
    b = _bare(t)
    return b.isin(*config.ACK_WORDS) | (F.length(b) <= 2) | ~b.rlike(r"[\p{L}\p{N}]")


def token_len(t: Column) -> Column:
    """Words of a text without leading, trailing or doubled spaces."""
    return F.when(F.length(t) > 0, F.size(F.split(t, " "))).otherwise(0)


def signal_score(t: Column, question: Column, url: Column) -> Column:
    score = F.least(F.lit(1.0), token_len(t) / F.lit(12.0)) + F.when(F.length(t) >= 80, 0.10).otherwise(0.0) + F.when(question, 0.05).otherwise(0.0) - F.when(url, 0.10).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def is_self_fact(t: Column) -> Column:
    return F.lower(F.coalesce(t, F.lit(""))).rlike("|".join(config.SELF_FACT_HINTS))


def style_signature(t: Column) -> Column:
    b = collapse(F.coalesce(t, F.lit("")))
    n = token_len(b)
    size = F.when(n <= 2, "tiny").when(n <= 6, "short").when(n <= 14, "mid").otherwise("long")
    upper = F.length(F.regexp_replace(b, r"[^\p{Lu}]", ""))
    letters = F.length(F.regexp_replace(b, r"[^\p{L}]", ""))
    tone = F.when(upper / F.greatest(F.lit(1), letters) > 0.35, "caps").otherwise("normal")
    flag = lambda end: F.when(F.endswith(b, F.lit(end)), "1").otherwise("0")
    return F.when(F.length(b) == 0, "empty").otherwise(F.concat(size, F.lit("|q"), flag("?"), F.lit("|e"), flag("!"), F.lit("|"), tone))


def filled(template: str, *columns: Column) -> Column:
    """A ``%s`` template with columns, null as empty."""
    return F.format_string(template, *(F.coalesce(c, F.lit("")) for c in columns))


def fuzzy_key(t: Column, unicode: bool = True) -> Column:
    """Text without case, accents and punctuation."""
    b = _bare(t)
    b = F.regexp_replace(_form(b, "decompose"), r"\p{Mn}", "") if unicode else b
    return F.regexp_replace(F.translate(b, config.FUZZY_PUNCTUATION, ""), r"(?U)\s+", " ")


def row_hash(version: str, *columns: Column) -> Column:
    """sha256 over columns that may be null."""
    return F.sha2(F.concat_ws("||", F.lit(version), *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)), 256)
