"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from prequenta.llm import bpe, crosstoken, decontaminate, html, katz, neardup, quality, secrets, suffixes, tokencount, topk, toxicity, whitening

QUERIES = {
    "op1_katz_scores": katz.op1_katz_scores,
    "op2_near_duplicates": neardup.op2_near_duplicates,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_repeated_strings": suffixes.op4_repeated_strings,
    "op5_token_counts": tokencount.op5_token_counts,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_bpe_roundtrip": bpe.op7_bpe_roundtrip,
    "op8_main_text": html.op8_main_text,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_exact_topk": topk.op10_exact_topk,
    "op11_token_alignment": crosstoken.op11_token_alignment,
    "op12_quality_rules": quality.op12_quality_rules,
    "op13_whitened_embeddings": whitening.op13_whitened_embeddings,
}

ORACLE = {"op10_exact_topk": topk.OP10_SQL}
