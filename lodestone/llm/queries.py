"""Queries of this subpackage by name, and SQL twins for those that SQL can express."""

from . import bpe, chat, decontaminate, html_text, jaccard, mixing, quality, secrets, sharding, warc

QUERIES = {
    "op1_decontaminate_fm_index": decontaminate.op1_decontaminate_fm_index,
    "op2_shard_histogram_sort": sharding.op2_shard_histogram_sort,
    "op5_chat_round_trip": chat.op5_chat_round_trip,
    "op4_context_mixing_ids": mixing.op4_context_mixing_ids,
    "op6_jaccard_pigeonhole": jaccard.op6_jaccard_pigeonhole,
    "op7_bpe_tree": bpe.op7_bpe_tree,
    "op3_secret_forest": secrets.op3_secret_forest,
    "op8_html_layout": html_text.op8_html_layout,
    "op9_fertility_rules": quality.op9_fertility_rules,
    "op10_warc_content_addressed": warc.op10_warc_content_addressed,
}
ORACLES = {
    "op6_jaccard_pigeonhole": jaccard.ORACLE_SQL,
    "op1_decontaminate_fm_index": decontaminate.ORACLE_SQL,
    "op5_chat_round_trip": chat.ORACLE_SQL,
    "op10_warc_content_addressed": warc.ORACLE_SQL,
}
