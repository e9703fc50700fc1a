"""Registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import ann, chat, decontam, fim, hard_negatives, langid, license, ngram_join, packing, quality, quality_rules, secrets, tokens

QUERIES = {
    "op1_license_scan": license.op1,
    "op2_section_tokens": tokens.op2,
    "op3_quality_fm": quality.op3,
    "op4_harmonic_packing": packing.op4,
    "op5_chat_format": chat.op5,
    "op6_ngram_jaccard": ngram_join.op6,
    "op7_language_spans": langid.op7,
    "op8_secret_scan": secrets.op8,
    "op9_decontamination": decontam.op9,
    "op10_block_neighbours": ann.op10,
    "op11_line_frequency": quality_rules.op11,
    "op12_hard_negatives": hard_negatives.op12,
    "op13_fill_in_middle": fim.op13,
}
ORACLES: dict[str, str] = {
    "op5_chat_format": chat.ORACLE,
    "op6_ngram_jaccard": ngram_join.ORACLE,
    "op8_secret_scan": secrets.ORACLE,
    "op9_decontamination": decontam.ORACLE,
    "op10_block_neighbours": ann.ORACLE,
    "op11_line_frequency": quality_rules.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
    "op13_fill_in_middle": fim.ORACLE,
}
