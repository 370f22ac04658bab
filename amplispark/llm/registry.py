"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from amplispark.llm import dedup, divergence, hard_negatives, html_text, langid, packing, quality, secrets, segmentation, sharding, topk, toxicity, url_filters

MODULES = (dedup, divergence, hard_negatives, html_text, langid, packing, quality, secrets, segmentation, sharding, topk, toxicity, url_filters)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
