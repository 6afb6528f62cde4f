"""The corpus operators' queries and their SQL."""

from threadloom.llm import bpe, chat, exact_dedup, language_id, line_dedup, matroska, near_dedup, packing, sharding, source_audit, substring_dedup, url_filter, vector_codes

QUERIES = {
    "op1_repeated_phrases": substring_dedup.op1_repeated_phrases,
    "op2_snapshot_collapse": chat.op2_snapshot_collapse,
    "op3_bayes_lsh": near_dedup.op3_bayes_lsh,
    "op4_linear_grouping": packing.op4_linear_grouping,
    "op5_jump_hash": sharding.op5_jump_hash,
    "op6_matroska": matroska.op6_matroska,
    "op7_content_sort": exact_dedup.op7_content_sort,
    "op8_letter_ratio": url_filter.op8_letter_ratio,
    "op9_crf": language_id.op9_crf,
    "op10_speculative_bpe": bpe.op10_speculative_bpe,
    "op11_source_divergence": source_audit.op11_source_divergence,
    "op12_line_dedup": line_dedup.op12_line_dedup,
    "op13_va_codes": vector_codes.op13_va_codes,
}
ORACLES = {
    "op1_repeated_phrases": substring_dedup.SQL,
    "op2_snapshot_collapse": chat.SQL,
    "op3_bayes_lsh": near_dedup.SQL,
    "op7_content_sort": exact_dedup.SQL,
    "op11_source_divergence": source_audit.SQL,
    "op12_line_dedup": line_dedup.SQL,
    "op13_va_codes": vector_codes.SQL,
}
