"""The queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

import corpus_pipeline
from veritile.llm import chat_format, decontamination, html_text, language_id, lattice, line_dedup, packing, quality_rules, simhash, token_counts

QUERIES = {
    "op1_lattice_scoring": lattice.query,
    "op2_quality_rules": quality_rules.query,
    "op3_decontamination": decontamination.query,
    "op4_line_dedup": line_dedup.query,
    "op5_token_counts": token_counts.query,
    "op6_chat_format": chat_format.query,
    "op7_simhash": simhash.query,
    "op8_best_fit_packing": packing.query,
    "op9_language_id": language_id.query,
    "op10_html_text": html_text.query,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {
    "op2_quality_rules": quality_rules.sql(),
    "op4_line_dedup": line_dedup.SQL,
    "op6_chat_format": chat_format.SQL,
}
