"""The queries of this package and their SQL."""

from __future__ import annotations

from quillon.llm import licenses, mixing, near_dedup, packing, quality, sharding, suffix_dedup, token_counts, topk, warc

_MODULES = (sharding, near_dedup, suffix_dedup, topk, warc, token_counts, mixing, packing, quality, licenses)


def queries() -> dict:
    return {name: getattr(m, name) for m in _MODULES for name in dir(m) if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in getattr(m, "ORACLE_SQL", {}).items()}
