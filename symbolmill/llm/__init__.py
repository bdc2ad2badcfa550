"""Operators that prepare training data. Nothing outside this subpackage imports it."""

from importlib import import_module

MODULES = ("q_language", "q_unparsed", "q_docpairs", "q_secrets", "q_provenance", "q_neardup", "q_tokens", "q_packing")


def queries():
    out = {}
    for m in MODULES:
        out |= import_module(f"symbolmill.llm.{m}").QUERIES
    return out


def oracle_sql():
    out = {}
    for m in MODULES:
        out |= getattr(import_module(f"symbolmill.llm.{m}"), "SQL", {})
    return out
