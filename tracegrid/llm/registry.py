"""The subpackage's queries and their SQL."""

from __future__ import annotations

from tracegrid.llm import decontaminate, forest_dedup, hard_negatives, mixing, packing, pii, secrets, simhash, sketches, substrings, toxicity, warc, whitening


def queries() -> dict:
    return {"op1_forest": forest_dedup.query, "op2_secrets": secrets.query, "op3_sketches": sketches.query, "op4_simhash": simhash.query, "op5_toxicity": toxicity.query, "op6_mixing": mixing.query, "op7_pii": pii.query, "op8_warc": warc.query, "op9_substrings": substrings.query, "op10_packing": packing.query, "op11_decontamination": decontaminate.query, "op12_hard_negatives": hard_negatives.query, "op13_whitening": whitening.query}


def oracle_sql() -> dict[str, str]:
    return {"op1_forest": forest_dedup.ORACLE, "op2_secrets": secrets.oracle(), "op6_mixing": mixing.oracle(), "op7_pii": pii.oracle(), "op8_warc": warc.ORACLE, "op9_substrings": substrings.ORACLE, "op11_decontamination": decontaminate.ORACLE, "op12_hard_negatives": hard_negatives.ORACLE}
