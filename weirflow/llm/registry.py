"""The queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

import importlib

#: number, module, function, name of the SQL constant or None
OPERATORS = [
    (1, "pii", "op1_pii", None),
    (2, "media", "op2_media_columns", None),
    (3, "licenses", "op3_license_scan", "OP3_SQL"),
    (4, "exact_dedup", "op4_exact_dedup", "OP4_SQL"),
    (5, "packing", "op5_best_fit_packing", None),
    (6, "quality", "op6_quality_classifier", None),
    (7, "sentencepiece_codec", "op7_sentencepiece", None),
    (8, "language_id", "op8_language_id", None),
    (9, "line_dedup", "op9_line_dedup", "OP9_SQL"),
    (10, "ngram_join", "op10_ngram_jaccard_join", None),
]


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"weirflow.llm.{module}"), name) for _, module, name, _ in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(importlib.import_module(f"weirflow.llm.{module}"), sql) for _, module, name, sql in OPERATORS if sql}
