"""Registered queries of the training-data operators and their DuckDB oracle SQL."""

from __future__ import annotations

from ridelens.llm import (
    decontaminate,
    minhash,
    mixing,
    prefix_trie,
    secrets_scan,
    sentencepiece_bpe,
    sharding,
    simhash,
    substring_dedup,
    token_files,
    toxicity,
    turn_repair,
    warc,
)

QUERIES = {f.__name__: f for f in (
    toxicity.op1_toxicity,
    warc.op2_warc_bundles,
    secrets_scan.op3_secret_scan,
    simhash.op4_simhash_near_dedup,
    mixing.op5_mix_sources,
    sharding.op6_shard_tree,
    decontaminate.op7_decontaminate,
    token_files.op8_token_output,
    minhash.op9_minhash_fingerprints,
    substring_dedup.op10_substring_dedup,
    turn_repair.op11_turn_repair,
    sentencepiece_bpe.op12_sentencepiece,
    prefix_trie.op13_prefix_trie,
)}

# The others need functions that SQL lacks (XXH64, CRC-32, a tokenizer, model fitting); tests hold those
# against brute force.
ORACLE_SQL: dict[str, str] = {
    "op2_warc_bundles": warc.ORACLE_SQL,
    "op5_mix_sources": mixing.ORACLE_SQL,
    "op7_decontaminate": decontaminate.ORACLE_SQL,
    "op10_substring_dedup": substring_dedup.ORACLE_SQL,
}
