"""The queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from sunfleet.llm import chat, decontamination, licenses, lm, media, neardup, packing, tokencounts, toxicity, warc


def queries() -> dict[str, Callable]:
    return {
        "op1_lm_scoring": lm.op1_query,
        "op2_warc": warc.op2_query,
        "op3_toxicity": toxicity.op3_query,
        "op4_chat_formatting": chat.op4_query,
        "op5_media_columns": media.op5_query,
        "op6_decontamination": decontamination.op6_query,
        "op7_best_fit_packing": packing.op7_query,
        "op8_license_scans": licenses.op8_query,
        "op9_token_counts": tokencounts.op9_query,
        "op10_minhash_near_dedup": neardup.op10_query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc": warc.OP2_SQL,
        "op4_chat_formatting": chat.OP4_SQL,
        "op8_license_scans": licenses.OP8_SQL,
        "op10_minhash_near_dedup": neardup.OP10_SQL,
    }
