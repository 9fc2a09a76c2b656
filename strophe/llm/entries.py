"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from . import alignment, decontaminate, html_text, licences, merkle, minhash, quality_classifier, quality_rules, secret_scan, sentencepiece_tokens, substring_dedup, toxicity, url_filter


def queries():
    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_quality_classifier": quality_classifier.op2_quality_classifier,
        "op3_html_text": html_text.op3_html_text,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_substring_dedup": substring_dedup.op5_substring_dedup,
        "op6_sentencepiece": sentencepiece_tokens.op6_sentencepiece,
        "op7_url_filter": url_filter.op7_url_filter,
        "op8_licence_scan": licences.op8_licence_scan,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_dart_minhash": minhash.op10_dart_minhash,
        "op11_secret_scan": secret_scan.op11_secret_scan,
        "op12_token_alignment": alignment.op12_token_alignment,
        "op13_merkle_manifest": merkle.op13_merkle_manifest,
    }


def oracle_sql():
    return {"op1_quality_rules": quality_rules.oracle(), "op5_substring_dedup": substring_dedup.oracle(), "op7_url_filter": url_filter.oracle(), "op8_licence_scan": licences.oracle(), "op10_dart_minhash": minhash.oracle(), "op11_secret_scan": secret_scan.oracle(), "op13_merkle_manifest": merkle.oracle()}
