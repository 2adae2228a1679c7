"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import chat, cross_entropy, decontaminate, fertility, language_id, line_dedup, mixing, simhash, url_filter, warc

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_simhash": simhash.op3_simhash,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_lm_scores": cross_entropy.op5_lm_scores,
    "op6_source_mix": mixing.op6_source_mix,
    "op7_quality_rules": fertility.op7_quality_rules,
    "op8_language_id": language_id.op8_language_id,
    "op9_warc_bundles": warc.op9_warc_bundles,
    "op10_chat_format": chat.op10_chat_format,
}

SQL = {
    "op1_line_dedup": line_dedup.OP1_SQL,
    "op2_url_filter": url_filter.OP2_SQL,
    "op6_source_mix": mixing.OP6_SQL,
    "op9_warc_bundles": warc.OP9_SQL,
    "op10_chat_format": chat.OP10_SQL,
}
