"""Names under which the operators of this subpackage are registered as queries."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: (module, query); the oracle, if SQL can express the query, is the module's ORACLE.
MODULES = [
    ("exact_dedup", "op3_exact_dedup"),
    ("token_count", "op8_token_counts"),
    ("packing", "op6_best_fit_packing"),
    ("decontam", "op4_decontamination"),
    ("chat", "op7_chat_format"),
    ("langid", "op9_language_id"),
    ("license_scan", "op10_license_scan"),
    ("toxicity", "op5_toxicity"),
    ("near_dedup", "op2_minhash_near_dedup"),
    ("substring_dedup", "op1_substring_dedup"),
]


#: Imported with this module, so whoever can import it has all of them.
_LOADED = {query: import_module(f"driftspan.llm.{module}") for module, query in MODULES}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {query: getattr(module, query) for query, module in _LOADED.items()}


def oracle_sql() -> dict[str, str]:
    return {query: module.ORACLE for query, module in _LOADED.items() if getattr(module, "ORACLE", None)}
