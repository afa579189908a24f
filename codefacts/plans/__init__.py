"""Registered queries."""

from . import (  # noqa: F401
    access_queries,
    code_queries,
    file_queries,
    graph_queries,
    record_queries,
    search_queries,
    stream_queries,
    text_queries,
)
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
