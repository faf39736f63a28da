"""The registered queries of the corpus operators, and their SQL where there is some."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from centroidal.llm.decontamination import op2_decontamination
from centroidal.llm.fill_in_middle import OP12_SQL, op12_fill_in_middle
from centroidal.llm.language_model import op5_language_model
from centroidal.llm.language_id import op6_language_id
from centroidal.llm.licence_scan import op11_licence_scan
from centroidal.llm.sharding import op10_shards
from centroidal.llm.simhash import op7_simhash
from centroidal.llm.source_divergence import OP13_SQL, op13_source_divergence
from centroidal.llm.streaming_bpe import op4_bpe
from centroidal.llm.substring_dedup import op1_substring_dedup
from centroidal.llm.token_counts import op8_token_counts
from centroidal.llm.toxicity import op9_toxicity
from centroidal.llm.vector_search import OP3_SQL, op3_exact_top_k

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_bpe": op4_bpe,
    "op5_language_model": op5_language_model,
    "op6_language_id": op6_language_id,
    "op7_simhash": op7_simhash,
    "op8_token_counts": op8_token_counts,
    "op9_toxicity": op9_toxicity,
    "op10_shards": op10_shards,
    "op11_licence_scan": op11_licence_scan,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_source_divergence": op13_source_divergence,
}
ORACLE_SQL: dict[str, str] = {
    "op3_exact_top_k": OP3_SQL,
    "op12_fill_in_middle": OP12_SQL,
    "op13_source_divergence": OP13_SQL,
}
