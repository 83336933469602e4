"""The ten queries op1 to op10 and the SQL for those that SQL can express."""

from __future__ import annotations

from tidemark.llm import bpe, grid_join, mixing, order_minhash, pii, quality, signature_tree, suffix_dedup, token_files, warc

QUERIES = {
    "op1_suffix_array_dedup": suffix_dedup.op1_suffix_array_dedup,
    "op7_ngram_jaccard_join": signature_tree.op7_ngram_jaccard_join,
    "op2_embedding_near_dedup": grid_join.op2_embedding_near_dedup,
    "op8_document_fingerprints": order_minhash.op8_document_fingerprints,
    "op9_pii": pii.op9_pii,
    "op4_quality_classifier": quality.op4_quality_classifier,
    "op3_token_counts": token_files.op3_token_counts,
    "op5_warc": warc.op5_warc,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op10_bpe": bpe.op10_bpe,
}

ORACLES = {
    "op7_ngram_jaccard_join": signature_tree.OP7_SQL,
    "op2_embedding_near_dedup": grid_join.OP2_SQL,
    "op5_warc": warc.OP5_SQL,
    "op6_mix_sources": mixing.OP6_SQL,
}
