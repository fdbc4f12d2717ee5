"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, chat, lines, lm, minhash, packing, quality, sitetree, topk, vectors

QUERIES = {
    "op1_best_fit_packing": packing.query,
    "op2_bpe_encoding": bpe.query,
    "op3_chat_formatting": chat.query,
    "op4_line_dedup": lines.query,
    "op5_quality_classifier": quality.query,
    "op6_exact_top_k": topk.query,
    "op7_lm_scoring": lm.query,
    "op8_embedding_near_dedup": vectors.query,
    "op9_html_extraction": sitetree.query,
    "op10_minhash_near_dedup": minhash.query,
}

ORACLES: dict[str, str] = {
    "op3_chat_formatting": chat.SQL,
    "op4_line_dedup": lines.SQL,
    "op6_exact_top_k": topk.SQL,
}
