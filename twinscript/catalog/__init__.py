"""Registered queries over the shared tables, each next to its SQL counterpart."""

from twinscript.catalog.registry import CATALOG

from twinscript.catalog import (  # noqa: F401  (importing registers the queries)
    audit_queries,
    column_queries,
    cost_queries,
    deck_queries,
    memory_queries,
    residual_queries,
    rule_queries,
)

__all__ = ["CATALOG"]
