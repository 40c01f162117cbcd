"""The registered queries of this subpackage and the SQL that some of them match."""

from __future__ import annotations

from graphloom.llm import bpe, chat, html, lattice, lines, media, neardup, phrases, quality, suffixes

QUERIES = {
    "op1_decontamination": phrases.op1,
    "op2_minhash_neardup": neardup.op2,
    "op3_media_columns": media.op3,
    "op4_chat_rotation": chat.op4,
    "op5_line_dedup": lines.op5,
    "op6_suffix_dedup": suffixes.op6,
    "op7_html_extraction": html.op7,
    "op8_byte_bpe": bpe.op8,
    "op9_quality_classifier": quality.op9,
    "op10_lm_scoring": lattice.op10,
}
ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": phrases.OP1_SQL,
    "op4_chat_rotation": chat.OP4_SQL,
    "op5_line_dedup": lines.OP5_SQL,
}
