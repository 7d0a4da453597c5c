"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from dayloom.llm import decontaminate, hard_negatives, importance, langid, line_dedup, mixing, near_dup, nearest, pii, secret_scan, substring_dedup, token_files, url_filter


def queries() -> dict:
    return {
        "op1_nearest": nearest.op1,
        "op2_substring_dedup": substring_dedup.op2,
        "op3_near_dup": near_dup.op3,
        "op4_pii": pii.op4,
        "op5_url_filter": url_filter.op5,
        "op6_mixing": mixing.op6,
        "op7_decontaminate": decontaminate.op7,
        "op8_langid": langid.op8,
        "op9_token_files": token_files.op9,
        "op10_line_dedup": line_dedup.op10,
        "op11_importance": importance.op11,
        "op12_secrets": secret_scan.op12,
        "op13_hard_negatives": hard_negatives.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_url_filter": url_filter.ORACLE,
        "op6_mixing": mixing.ORACLE,
        "op7_decontaminate": decontaminate.ORACLE,
        "op11_importance": importance.ORACLE,
        "op13_hard_negatives": hard_negatives.ORACLE,
    }
