"""The registered queries of this package and their SQL over the same whole tables."""

from __future__ import annotations

from shelfmark.llm import (conversation_trie, decontamination, exact_dedup, jaccard_join, language, licenses, minhash_dedup, packing, periodic_runs,
                           pii, substring_dedup, suffix_dedup, toxicity)


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


QUERIES = {
    "op1_exact_dedup": lambda spark, folder: exact_dedup.op1_exact_dedup(table(spark, folder, "documents")),
    "op2_suffix_dedup": lambda spark, folder: suffix_dedup.op2_suffix_dedup(table(spark, folder, "documents")),
    "op3_packing": lambda spark, folder: packing.op3_packing(table(spark, folder, "documents")),
    "op4_jaccard_join": lambda spark, folder: jaccard_join.op4_jaccard_join(table(spark, folder, "documents")),
    "op5_decontamination": lambda spark, folder: decontamination.op5_decontamination(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")),
    "op6_pii_surrogates": lambda spark, folder: pii.op6_pii_surrogates(table(spark, folder, "documents")),
    "op7_toxicity": lambda spark, folder: toxicity.op7_toxicity(
        table(spark, folder, "documents"), table(spark, folder, "labels")),
    "op8_license_scan": lambda spark, folder: licenses.op8_license_scan(table(spark, folder, "documents")),
    "op9_substring_dedup": lambda spark, folder: substring_dedup.op9_substring_dedup(table(spark, folder, "documents")),
    "op10_language_id": lambda spark, folder: language.op10_language_id(table(spark, folder, "documents")),
    "op11_periodic_runs": lambda spark, folder: periodic_runs.op11_periodic_runs(table(spark, folder, "documents")),
    "op12_conversation_trie": lambda spark, folder: conversation_trie.op12_conversation_trie(table(spark, folder, "conversations")),
    "op13_minhash_dedup": lambda spark, folder: minhash_dedup.op13_minhash_dedup(table(spark, folder, "documents")),
}

ORACLE = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op12_conversation_trie": conversation_trie.ORACLE,
}
