"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import best_fit, bit_sliced, elkan, exact_dedup, filter_audit, jaccard_join, licences, mixing, quality_classifier, quality_rules, sharding, substring_dedup, suffix_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_licences": licences.op1_licences,
        "op2_substring_dedup": substring_dedup.op2_substring_dedup,
        "op3_jaccard_join": jaccard_join.op3_jaccard_join,
        "op4_sharding": sharding.op4_sharding,
        "op5_quality_classifier": quality_classifier.op5_quality_classifier,
        "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
        "op7_quality_rules": quality_rules.op7_quality_rules,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_mixing": mixing.op9_mixing,
        "op10_best_fit": best_fit.op10_best_fit,
        "op11_filter_audit": filter_audit.op11_filter_audit,
        "op12_topk": bit_sliced.op12_topk,
        "op13_elkan": elkan.op13_elkan,
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_filter_audit": filter_audit.OP11_SQL, "op12_topk": bit_sliced.OP12_SQL, "op13_elkan": elkan.OP13_SQL, "op1_licences": licences.OP1_SQL, "op2_substring_dedup": substring_dedup.OP2_SQL, "op3_jaccard_join": jaccard_join.OP3_SQL, "op6_suffix_dedup": suffix_dedup.OP6_SQL, "op8_exact_dedup": exact_dedup.OP8_SQL}
