"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import decontaminate, language, packing, quality, scoring, secrets, simhash, substring, tokencount, topk

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_lm_score": scoring.op2_lm_score,
    "op3_top_k": topk.op3_top_k,
    "op4_packing": packing.op4_packing,
    "op5_simhash": simhash.op5_simhash,
    "op6_token_counts": tokencount.op6_token_counts,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_quality": quality.op8_quality,
    "op9_language": language.op9_language,
    "op10_substring_dedup": substring.op10_substring_dedup,
}
ORACLES = {
    "op1_decontaminate": decontaminate.ORACLE_SQL,
    "op3_top_k": topk.ORACLE_SQL,
    "op10_substring_dedup": substring.ORACLE_SQL,
}
