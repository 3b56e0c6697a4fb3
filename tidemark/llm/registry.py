"""Queries of the training-data operators, by name, and their SQL where there is any."""

from __future__ import annotations

from tidemark.llm import bpe, decontaminate, jaccard_join, language_id, license_scan, lm_score, periodic_runs, pipeline, quality_model, quality_rules, ranked_search, secret_scan, suffix_dedup, warc

QUERIES = {
    "pipeline": pipeline.run,
    "op1_language_id": language_id.query,
    "op2_jaccard_join": jaccard_join.query,
    "op3_license_scan": license_scan.query,
    "op4_byte_bpe": bpe.query,
    "op5_quality_rules": quality_rules.query,
    "op6_warc_revisits": warc.query,
    "op7_suffix_dedup": suffix_dedup.query,
    "op8_decontamination": decontaminate.query,
    "op9_lm_score": lm_score.query,
    "op10_quality_model": quality_model.query,
    "op11_secret_scan": secret_scan.query,
    "op12_periodic_runs": periodic_runs.query,
    "op13_ranked_search": ranked_search.query,
}

ORACLE_SQL: dict[str, str] = {
    "op6_warc_revisits": warc.ORACLE,
    "op8_decontamination": decontaminate.ORACLE,
    "op13_ranked_search": ranked_search.ORACLE,
}
