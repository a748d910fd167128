"""The training-data queries, and SQL for those that SQL can express."""

from __future__ import annotations

from . import ann, bpe, conversations, divergence, embedding_dedup, jaccard, packing, recurrent_lm, speculate, suffix_dedup, toxicity, url_filter, warc

QUERIES = {
    "op1_nn_descent": ann.op1,
    "op2_embedding_dedup": embedding_dedup.op2,
    "op3_byte_bpe": bpe.op3,
    "op4_packing": packing.op4,
    "op5_recurrent_lm": recurrent_lm.op5,
    "op6_toxicity": toxicity.op6,
    "op7_warc_revisits": warc.op7,
    "op8_jaccard_join": jaccard.op8,
    "op9_url_filter": url_filter.op9,
    "op10_suffix_dedup": suffix_dedup.op10,
    "op11_conversation_repair": conversations.op11,
    "op12_speculative_bpe": speculate.op12,
    "op13_source_divergence": divergence.op13,
}

ORACLES: dict[str, str] = {
    "op7_warc_revisits": warc.ORACLE,
    "op13_source_divergence": divergence.ORACLE,
}
