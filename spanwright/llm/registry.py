"""Queries of the corpus operators and the SQL of those that SQL can express."""

from spanwright.llm import langid, lmscore, media, neardup, packing, sampling, substring, tokens, topk, warc

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_substring_dedup": substring.op2_substring_dedup,
    "op3_minhash_near_dedup": neardup.op3_minhash_near_dedup,
    "op4_media_columns": media.op4_media_columns,
    "op5_warc_archive": warc.op5_warc_archive,
    "op6_language_id": langid.op6_language_id,
    "op7_exact_topk": topk.op7_exact_topk,
    "op8_token_packing": tokens.op8_token_packing,
    "op9_sentencepiece_sampling": sampling.op9_sentencepiece_sampling,
    "op10_lm_scoring": lmscore.op10_lm_scoring,
}
ORACLES = {
    "op2_substring_dedup": substring.OP2_SQL,
    "op5_warc_archive": warc.OP5_SQL,
    "op7_exact_topk": topk.OP7_SQL,
}
