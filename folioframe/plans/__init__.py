"""The queries over the given tables."""

from importlib import import_module

MODULES = ("catalogue", "texts", "records", "retrieval", "sources", "more", "harvest", "fields", "search", "landed", "mapped", "reports", "flows")


def all_queries() -> tuple[dict, dict]:
    """(queries, SQL) by name."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    from .registry import QUERIES, SQL

    return dict(QUERIES), dict(SQL)
