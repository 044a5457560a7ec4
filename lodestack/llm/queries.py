"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from lodestack.llm import bpe, chat_format, collocations, embedding_dedup, exact_dedup, langid, mixing, packing, prefix_trie, sharding, simhash, toxicity, wordpiece

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_sharding": sharding.op3_sharding,
    "op4_embedding_dedup": embedding_dedup.op4_embedding_dedup,
    "op5_langid": langid.op5_langid,
    "op6_packing": packing.op6_packing,
    "op7_token_counts": wordpiece.op7_token_counts,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_simhash": simhash.op9_simhash,
    "op10_mixing": mixing.op10_mixing,
    "op11_chat_format": chat_format.op11_chat_format,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_collocations": collocations.op13_collocations,
}

SQL = {
    "op4_embedding_dedup": embedding_dedup.OP4_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
    "op10_mixing": mixing.OP10_SQL,
    "op11_chat_format": chat_format.OP11_SQL,
    "op12_prefix_trie": prefix_trie.OP12_SQL,
    "op13_collocations": collocations.OP13_SQL,
}
