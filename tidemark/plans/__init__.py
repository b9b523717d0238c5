"""Named queries over the given tables."""

from importlib import import_module

from tidemark.plans.catalog import ORACLE, QUERIES

MODULES = [
    "flagship", "queries_bars", "queries_fields", "queries_flow", "queries_indicators", "queries_screens", "queries_risk", "queries_tables", "queries_book", "queries_pool", "queries_streaming", "queries_binary",
]


def _load() -> None:
    for name in MODULES:
        import_module(f"tidemark.plans.{name}")


def all_queries():
    _load()
    return dict(QUERIES)


def all_sql():
    _load()
    return dict(ORACLE)
