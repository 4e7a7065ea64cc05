"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontaminate, html_text, jaccard, lm_score, media, packing, secrets, span_dedup, toxicity, url_filter

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_media": media.op3_media,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_ngram_jaccard_join": jaccard.op5_ngram_jaccard_join,
    "op6_lm_score": lm_score.op6_lm_score,
    "op7_html_extraction": html_text.op7_html_extraction,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_substring_dedup": span_dedup.op9_substring_dedup,
    "op10_decontamination": decontaminate.op10_decontamination,
}

ORACLE_SQL = {
    "op8_url_filter": url_filter.SQL,
}
