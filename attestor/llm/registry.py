"""The queries of these operators over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from . import chat, decontaminate, lm_scoring, packing, quality, repair, simhash, toxicity, urls, weighted_sampling


def queries() -> dict[str, Callable]:
    return {
        "op1_lm_scoring": lm_scoring.query,
        "op2_best_fit_packing": packing.query,
        "op3_decontamination": decontaminate.query,
        "op4_quality": quality.query,
        "op5_chat_format": chat.query,
        "op6_token_output": repair.query,
        "op7_toxicity": toxicity.query,
        "op8_url_filter": urls.query,
        "op9_fingerprints": weighted_sampling.query,
        "op10_simhash": simhash.query,
    }


def oracle_sql() -> dict[str, str]:
    """Where SQL can express the whole result; the others are tested against brute force."""
    return {"op3_decontamination": decontaminate.ORACLE, "op5_chat_format": chat.ORACLE}
