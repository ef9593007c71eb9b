"""Queries of this package by name, and their SQL where SQL can express them."""

from __future__ import annotations

from tidemark.llm import bpe, edit_embedding, language, line_dedup, nearest, ngram_lm, packing, quality, simhash, warc


def queries() -> dict:
    return {
        "op1_fingerprints": edit_embedding.op1_fingerprints,
        "op2_bpe": bpe.op2_bpe,
        "op3_quality": quality.op3_quality,
        "op4_warc": warc.op4_warc,
        "op5_language": language.op5_language,
        "op6_line_dedup": line_dedup.op6_line_dedup,
        "op7_simhash": simhash.op7_simhash,
        "op8_packing": packing.op8_packing,
        "op9_nearest": nearest.op9_nearest,
        "op10_ngram_lm": ngram_lm.op10_ngram_lm,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_warc": warc.ORACLE_SQL,
        "op6_line_dedup": line_dedup.ORACLE_SQL,
    }
