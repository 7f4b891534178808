"""All queries of the engine's own operators."""

from . import document_queries, nested_queries, reader_queries, scalar_queries, service_queries, table_queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "document_queries", "nested_queries", "reader_queries", "scalar_queries", "service_queries", "table_queries"]
