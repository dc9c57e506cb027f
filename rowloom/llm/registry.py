"""All queries of the subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from rowloom.llm import (
    external_shuffle,
    license_scan,
    minmax_dedup,
    pii_boost,
    piece_codec,
    quality_mcd,
    source_mixing,
    topk_search,
    toxic_subwords,
    url_templates,
)

MODULES = [
    topk_search,
    license_scan,
    url_templates,
    source_mixing,
    minmax_dedup,
    external_shuffle,
    quality_mcd,
    toxic_subwords,
    piece_codec,
    pii_boost,
]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
