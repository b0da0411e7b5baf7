"""The subpackage's queries and their SQL, under the names that __spark_entry__ registers."""

from __future__ import annotations

from folioscope.llm import decontaminate, exact, minhash, mixing, pii, quality, shard, substrings, tokens, urls

QUERIES = {
    "op1_ordinal_quality": quality.op1,
    "op2_anchor_expansion_pii": pii.op2,
    "op3_simhash_decontamination": decontaminate.op3,
    "op4_stratified_shards": shard.op4,
    "op5_order_minhash": minhash.op5,
    "op6_suffix_tree_repeats": substrings.op6,
    "op7_host_reputation": urls.op7,
    "op8_progressive_exact_dedup": exact.op8,
    "op9_offset_mapped_tokens": tokens.op9,
    "op10_raked_mixture": mixing.op10,
}
ORACLE_SQL = {
    "op3_simhash_decontamination": decontaminate.OP3_SQL,
    "op6_suffix_tree_repeats": substrings.OP6_SQL,
    "op7_host_reputation": urls.OP7_SQL,
    "op8_progressive_exact_dedup": exact.OP8_SQL,
}
