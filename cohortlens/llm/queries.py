"""Registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortlens.llm.bpe import op1_bpe
from cohortlens.llm.bytebpe import op12_byte_bpe
from cohortlens.llm.embeddings import op9_embedding_dedup
from cohortlens.llm.jaccard import op6_jaccard_join
from cohortlens.llm.language import op3_language_id
from cohortlens.llm.merkle import op4_fingerprints
from cohortlens.llm.packing import op8_packing
from cohortlens.llm.quality import op5_quality
from cohortlens.llm.resampling import OP13_SQL, op13_resampling
from cohortlens.llm.substrings import op10_substring_dedup
from cohortlens.llm.toxicity import op2_toxicity
from cohortlens.llm.urls import op7_url_filter
from cohortlens.llm.whitening import op11_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_toxicity": op2_toxicity,
    "op3_language_id": op3_language_id,
    "op4_fingerprints": op4_fingerprints,
    "op5_quality": op5_quality,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_url_filter": op7_url_filter,
    "op8_packing": op8_packing,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_whitening": op11_whitening,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_resampling": op13_resampling,
}
ORACLES: dict[str, str] = {"op13_resampling": OP13_SQL}
