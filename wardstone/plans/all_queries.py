"""Imports every module that registers queries."""

from . import decision_queries, evaluation_queries, report_queries, source_queries, store_queries, table_queries, text_queries  # noqa: F401
