"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratapanel.llm import centroid_language, compression_rules, conversation_repair, decontamination, licenses, near_dups, packing, periodic_runs, pii, simhash, substring_dedup, suffix_tree, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": pii.op1_pii,
    "op2_near_duplicates": near_dups.op2_near_duplicates,
    "op3_suffix_tree_score": suffix_tree.op3_suffix_tree_score,
    "op4_compression_rules": compression_rules.op4_compression_rules,
    "op5_centroid_language": centroid_language.op5_centroid_language,
    "op6_pack_best_two_fit": packing.op6_pack_best_two_fit,
    "op10_decontaminate": decontamination.op10_decontaminate,
    "op7_license_digests": licenses.op7_license_digests,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op11_simhash": simhash.op11_simhash,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}
ORACLES: dict[str, str] = {
    "op1_pii": pii.ORACLE,
    "op2_near_duplicates": near_dups.ORACLE,
    "op7_license_digests": licenses.oracle(),
    "op9_substring_dedup": substring_dedup.ORACLE,
    "op12_conversation_repair": conversation_repair.ORACLE,
    "op13_periodic_runs": periodic_runs.ORACLE,
}
