"""The queries of this folder, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from segmentry.llm import chat, collocations, decontam, langid, licenses, minhash, negatives, packing, quality, tokencounts, tokenfiles, topk, vectordups
from segmentry.llm.oracles import SQL  # noqa: F401

QUERIES = {
    "op1_token_counts": tokencounts.op1_token_counts,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_minhash_dedup": minhash.op3_minhash_dedup,
    "op4_quality_classifier": quality.op4_quality_classifier,
    "op5_decontamination": decontam.op5_decontamination,
    "op6_language_id": langid.op6_language_id,
    "op7_token_files": tokenfiles.op7_token_files,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_chat_format": chat.op9_chat_format,
    "op10_exact_topk": topk.op10_exact_topk,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_vector_dedup": vectordups.op12_vector_dedup,
    "op13_collocations": collocations.op13_collocations,
    "pipeline": corpus_pipeline.run,
}
