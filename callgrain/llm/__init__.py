"""Training-data operators.  Nothing outside this folder imports it.

``queries()`` and ``oracle_sql()`` gather the registered queries of the
operators; each operator lives in a module of its own.
"""

from __future__ import annotations

from callgrain.llm import cover_search, hyperminhash, lexicon_bpe, license_scan, mixing, quality_gbt, rank_sync, secret_scan, spelling, suffix_dedup, toxicity, warc

MODULES = [suffix_dedup, rank_sync, cover_search, toxicity, quality_gbt, license_scan, lexicon_bpe, mixing, hyperminhash, warc, spelling, secret_scan]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
