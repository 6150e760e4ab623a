"""The queries of this folder and their SQL, by name."""

from __future__ import annotations

from tarn.llm import centroids, ctw, decontaminate, hard_negatives, licenses, mixing, pii, quality, secrets, simhash, site_style, substring_dedup, url_filter

_MODULES = {
    "op1_secrets": secrets,
    "op2_mixing": mixing,
    "op3_simhash": simhash,
    "op4_quality_rules": quality,
    "op5_substring_dedup": substring_dedup,
    "op6_decontaminate": decontaminate,
    "op7_url_filter": url_filter,
    "op8_pii": pii,
    "op9_licenses": licenses,
    "op10_ctw": ctw,
    "op11_hard_negatives": hard_negatives,
    "op12_site_style": site_style,
    "op13_exponion": centroids,
}


def queries() -> dict:
    return {name: m.query for name, m in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: m.SQL for name, m in _MODULES.items() if m.SQL}
