"""The queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = {
    "op1_site_tree_text": "html_text",
    "op2_byte_gru_language": "language",
    "op3_license_rules": "licenses",
    "op4_projection_dedup": "vector_dedup",
    "op5_pretoken_counts": "token_counts",
    "op6_byte_shards": "sharding",
    "op7_warc_derivatives": "warc",
    "op8_lsh_forest_join": "jaccard_join",
    "op9_benchmark_windows": "decontamination",
    "op10_chunked_bpe": "byte_bpe",
    "op11_byte_cnn_quality": "quality",
    "op12_reduced_alphabet_variants": "spelling",
    "op13_bitmap_rank_manifest": "merkle",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: import_module(f"shelfwise.llm.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    modules = {name: import_module(f"shelfwise.llm.{module}") for name, module in MODULES.items()}
    return {name: m.ORACLE for name, m in modules.items() if getattr(m, "ORACLE", None)}
