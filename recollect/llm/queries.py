"""The operators' queries, by the names under which ``__spark_entry__.py`` offers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recollect.llm import oracles
from recollect.llm.decontamination import op1_decontamination
from recollect.llm.embedding import op5_near_embeddings
from recollect.llm.html import op7_html
from recollect.llm.jaccard import op4_jaccard_join
from recollect.llm.katz import op2_katz
from recollect.llm.mixing import op9_mixing
from recollect.llm.pii import op8_pii
from recollect.llm.quality import op3_quality
from recollect.llm.sharding import op6_sharding
from recollect.llm.toxicity import op10_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_katz": op2_katz,
    "op3_quality": op3_quality,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_near_embeddings": op5_near_embeddings,
    "op6_sharding": op6_sharding,
    "op7_html": op7_html,
    "op8_pii": op8_pii,
    "op9_mixing": op9_mixing,
    "op10_toxicity": op10_toxicity,
}
#: The other results hang on trained weights, hashes or layout, which SQL cannot express; brute force tests them.
ORACLE_SQL: dict[str, str] = {"op1_decontamination": oracles.OP1, "op4_jaccard_join": oracles.OP4, "op5_near_embeddings": oracles.OP5}
