"""The registered queries of this folder and, where SQL can express one, its SQL."""

from __future__ import annotations

from . import ann_forest, byte_bpe, edit_counts, hard_negatives, html_extract, lexical_search, minhash_dedup, mixing, quality_classifier, quality_rules, secret_scan, token_store, toxicity


def queries() -> dict:
    return {
        "op1_minhash_near_dedup": minhash_dedup.query,
        "op2_token_store": token_store.query,
        "op3_html_extract": html_extract.query,
        "op4_ann_forest": ann_forest.query,
        "op5_mixing": mixing.query,
        "op6_toxicity": toxicity.query,
        "op7_quality_rules": quality_rules.query,
        "op8_byte_bpe": byte_bpe.query,
        "op9_edit_token_counts": edit_counts.query,
        "op10_quality_classifier": quality_classifier.query,
        "op11_secret_scan": secret_scan.query,
        "op12_lexical_search": lexical_search.query,
        "op13_hard_negatives": hard_negatives.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_mixing": mixing.SQL,
        "op7_quality_rules": quality_rules.SQL,
        "op12_lexical_search": lexical_search.SQL,
        "op13_hard_negatives": hard_negatives.SQL,
    }
