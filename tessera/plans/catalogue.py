"""Every registered query of the engine proper, with its SQL."""

from __future__ import annotations

from . import bundle_queries, graph_queries, rank_queries, rule_queries, rule_tree, search_queries, store_queries, tree_queries  # noqa: F401  (they register)
from .registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
