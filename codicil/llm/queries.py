"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from codicil.llm import conversation_repair, license_scan, merkle, mixing, ngram_join, packing, prefix_trie, quality, secret_scan, sharding, substring_dedup, token_counts, token_files

QUERIES = {
    f.__name__: f
    for f in (
        substring_dedup.op1_substring_dedup,
        secret_scan.op2_secret_scan,
        ngram_join.op3_ngram_jaccard_join,
        license_scan.op4_license_scan,
        mixing.op5_source_mix,
        token_files.op6_token_files,
        quality.op7_quality_rules,
        packing.op8_best_fit_packing,
        merkle.op9_fingerprints,
        token_counts.op10_token_counts,
        conversation_repair.op11_conversation_repair,
        sharding.op12_shuffled_shards,
        prefix_trie.op13_prefix_trie,
    )
}
ORACLE_SQL = {
    "op4_license_scan": license_scan.OP4_SQL,
    "op5_source_mix": mixing.OP5_SQL,
    "op11_conversation_repair": conversation_repair.OP11_SQL,
    "op13_prefix_trie": prefix_trie.OP13_SQL,
}
