"""The registered queries of the operators and their SQL."""

from __future__ import annotations

from . import bpe, chat, lines, pii, quality, simhash, sketch, tiling, toxicity, urls

QUERIES = {
    "op1_chat": chat.op1_chat,
    "op2_lines": lines.op2_lines,
    "op3_fingerprints": sketch.op3_fingerprints,
    "op4_simhash": simhash.op4_simhash,
    "op5_pii": pii.op5_pii,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_quality": quality.op7_quality,
    "op8_urls": urls.op8_urls,
    "op9_tiling": tiling.op9_tiling,
    "op10_bpe": bpe.op10_bpe,
}
ORACLE: dict[str, str] = {"op1_chat": chat.SQL, "op2_lines": lines.SQL, "op8_urls": urls.SQL}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
