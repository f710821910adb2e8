"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from piiflow.llm import chat_format, decontamination, divergence, fill_middle, html_extract, line_dedup, mixing, quality_rules, secret_scans, simhash, suffix_dedup, token_counts, toxicity


def queries() -> dict:
    return {
        "op1_decontamination": decontamination.query,
        "op2_secret_scans": secret_scans.query,
        "op3_line_dedup": line_dedup.query,
        "op4_simhash": simhash.query,
        "op5_mixing": mixing.query,
        "op6_quality_rules": quality_rules.query,
        "op7_suffix_dedup": suffix_dedup.query,
        "op8_html_extract": html_extract.query,
        "op9_chat_format": chat_format.query,
        "op10_token_counts": token_counts.query,
        "op11_toxicity": toxicity.query,
        "op12_divergence": divergence.query,
        "op13_fill_middle": fill_middle.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": decontamination.SQL, "op3_line_dedup": line_dedup.SQL, "op5_mixing": mixing.SQL, "op9_chat_format": chat_format.SQL, "op12_divergence": divergence.SQL, "op13_fill_middle": fill_middle.SQL}
