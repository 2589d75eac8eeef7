"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from . import chat_format, decontamination, near_dedup, pii, prefix_trie, quality_classifier, quality_rules, stream_dedup, structure_repair, token_counts, url_filter, warc, word_bpe

QUERIES = {
    "op1_near_dedup": near_dedup.op1_near_dedup,
    "op2_warc": warc.op2_warc,
    "op3_pii": pii.op3_pii,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_quality_classifier": quality_classifier.op8_quality_classifier,
    "op9_chat_format": chat_format.op9_chat_format,
    "op10_word_bpe": word_bpe.op10_word_bpe,
    "op11_stream_dedup": stream_dedup.op11_stream_dedup,
    "op12_structure_repair": structure_repair.op12_structure_repair,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

ORACLE_SQL = {
    "op2_warc": warc.OP2_SQL,
    "op6_decontamination": decontamination.OP6_SQL,
    "op7_url_filter": url_filter.OP7_SQL,
    "op9_chat_format": chat_format.OP9_SQL,
    "op11_stream_dedup": stream_dedup.OP11_SQL,
    "op12_structure_repair": structure_repair.OP12_SQL,
    "op13_prefix_trie": prefix_trie.OP13_SQL,
}
