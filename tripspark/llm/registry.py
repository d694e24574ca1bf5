"""The text queries and their SQL."""

from __future__ import annotations

from tripspark.llm import bpe, exact_dedup, fill_middle, language_id, license_scan, line_dedup, mixing, ngram_join, quality_rules, spelling_variants, suffix_dedup, token_counts, url_filter


def queries() -> dict:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
        "op3_line_dedup": line_dedup.op3_line_dedup,
        "op4_mix_sources": mixing.op4_mix_sources,
        "op5_bpe": bpe.op5_bpe,
        "op6_ngram_join": ngram_join.op6_ngram_join,
        "op7_license_scan": license_scan.op7_license_scan,
        "op8_quality_rules": quality_rules.op8_quality_rules,
        "op9_language_id": language_id.op9_language_id,
        "op10_token_counts": token_counts.op10_token_counts,
        "op11_spelling_variants": spelling_variants.op11_spelling_variants,
        "op12_url_filter": url_filter.op12_url_filter,
        "op13_fill_middle": fill_middle.op13_fill_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact_dedup.ORACLE,
        "op2_suffix_dedup": suffix_dedup.ORACLE,
        "op3_line_dedup": line_dedup.ORACLE,
        "op6_ngram_join": ngram_join.ORACLE,
        "op7_license_scan": license_scan.ORACLE,
        "op8_quality_rules": quality_rules.ORACLE,
        "op11_spelling_variants": spelling_variants.ORACLE,
        "op12_url_filter": url_filter.ORACLE,
        "op13_fill_middle": fill_middle.ORACLE,
    }
