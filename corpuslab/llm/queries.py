"""The registered queries of the training-text operators and their SQL."""

from __future__ import annotations

from corpuslab.llm import exact_dedup, filter_audit, flac, jaccard_join, language_id, license_scan, mixing, secret_scan, sentencepiece_bpe, sharding, simhash, source_divergence, toxicity

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_language_id": language_id.op2_language_id,
    "op3_mixing": mixing.op3_mixing,
    "op4_sentencepiece": sentencepiece_bpe.op4_sentencepiece,
    "op5_sharding": sharding.op5_sharding,
    "op6_simhash": simhash.op6_simhash,
    "op7_secrets": secret_scan.op7_secrets,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_flac": flac.op9_flac,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_source_divergence": source_divergence.op12_source_divergence,
    "op13_jaccard_join": jaccard_join.op13_jaccard_join,
}
ORACLES = {
    "op3_mixing": mixing.OP3_SQL,
    "op10_exact_dedup": exact_dedup.OP10_SQL,
    "op11_filter_audit": filter_audit.OP11_SQL,
    "op12_source_divergence": source_divergence.OP12_SQL,
}
