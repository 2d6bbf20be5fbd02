"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from folioframe.llm import best_fit, html_text, lm, media, mixing, neardup, packing, phrases, quality, secrets, spill_align, topk, toxicity

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_top_k": topk.op2_top_k,
    "op3_near_duplicates": neardup.op3_near_duplicates,
    "op4_lm_scores": lm.op4_lm_scores,
    "op5_quality": quality.op5_quality,
    "op6_scan_secrets": secrets.op6_scan_secrets,
    "op7_score_toxicity": toxicity.op7_score_toxicity,
    "op8_pack_power_of_two": packing.op8_pack_power_of_two,
    "op9_media_columns": media.op9_media_columns,
    "op10_extract_text": html_text.op10_extract_text,
    "op11_collocations": phrases.op11_collocations,
    "op12_align_tokenizers": spill_align.op12_align_tokenizers,
    "op13_best_fit": best_fit.op13_best_fit,
}

ORACLE_SQL = {
    "op1_mix_sources": mixing.OP1_SQL,
    "op2_top_k": topk.OP2_SQL,
    "op11_collocations": phrases.OP11_SQL,
}
