"""Registered queries: name to function, and name to DuckDB SQL where there is one."""

from . import building, corpus, markdown, routing, search
from .search import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "building", "corpus", "markdown", "routing", "search"]
