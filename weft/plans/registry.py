"""All registered queries and their oracle SQL, merged from the plan modules."""

from __future__ import annotations

import importlib

MODULES = ("corpus", "audit", "ordering", "relational", "vectors", "text", "sources", "tokens", "batchmap", "splits", "retrieval")


def _load():
    queries, oracle = {}, {}
    for name in MODULES:
        mod = importlib.import_module(f"weft.plans.{name}")
        for key in mod.QUERIES:
            if key in queries:
                raise ValueError(f"duplicate query {key}")
        queries.update(mod.QUERIES)
        oracle.update(mod.ORACLE)
    return queries, oracle


def queries():
    return _load()[0]


def oracle_sql():
    return _load()[1]
