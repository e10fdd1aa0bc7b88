"""Operators for training-data pipelines, their queries and SQL."""

from __future__ import annotations

from . import codes, decontaminate, jaccard, licences, lines, packing, preferences, quality, ranking, repeats, resampling, toxicity, warc


def queries():
    return {
        "op1_ngram_jaccard": jaccard.op1_ngram_jaccard,
        "op2_warc": warc.op2_warc,
        "op3_substring_dedup": repeats.op3_substring_dedup,
        "op4_best_fit_packing": packing.op4_best_fit_packing,
        "op5_license_scan": licences.op5_license_scan,
        "op6_line_dedup": lines.op6_line_dedup,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_decontamination": decontaminate.op8_decontamination,
        "op9_preference_format": preferences.op9_preference_format,
        "op10_quality_rules": quality.op10_quality_rules,
        "op11_quality_ranking": ranking.op11_quality_ranking,
        "op12_importance_resampling": resampling.op12_importance_resampling,
        "op13_vector_codes": codes.op13_vector_codes,
    }


def oracle_sql():
    return {
        "op1_ngram_jaccard": jaccard.OP1_SQL,
        "op2_warc": warc.OP2_SQL,
        "op3_substring_dedup": repeats.OP3_SQL,
        "op6_line_dedup": lines.OP6_SQL,
        "op9_preference_format": preferences.OP9_SQL,
        "op10_quality_rules": quality.OP10_SQL,
        "op12_importance_resampling": resampling.OP12_SQL,
        "op13_vector_codes": codes.OP13_SQL,
    }
