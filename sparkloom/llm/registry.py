"""The subpackage's queries and the SQL that checks them."""

from __future__ import annotations

import importlib

from sparkloom.llm.common import ship

#: name of the query -> module that has it, and oracle() where SQL can express it
QUERIES = {
    "op1_line_dedup": "line_dedup",
    "op2_language_id": "language",
    "op3_warc_captures": "warc",
    "op4_license_scan": "license_scan",
    "op5_embedding_dedup": "neighbours",
    "op6_url_filter": "url_filter",
    "op7_minhash_dedup": "minhash",
    "op8_katz_scores": "katz",
    "op9_decontaminate": "decontaminate",
    "op10_mixing": "mixing",
    "op11_filter_audit": "filter_audit",
    "op12_exact_dedup": "exact_dedup",
    "op13_turn_repair": "turn_repair",
}


def _module(name: str):
    return importlib.import_module(f"sparkloom.llm.{QUERIES[name]}")


def _shipped(name: str):
    def query(spark, sf_dir):
        ship(spark)
        return getattr(_module(name), name)(spark, sf_dir)

    query.__name__ = name
    return query


def queries() -> dict:
    return {name: _shipped(name) for name in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: _module(name).oracle() for name in QUERIES if hasattr(_module(name), "oracle")}
