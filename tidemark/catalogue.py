"""All registered queries; importing this module registers them."""

from __future__ import annotations

from . import assembly_queries, document_queries, evidence_queries, map_queries, measure_queries, queries, question_queries, report_queries, state_queries, text_queries
from .registering import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "assembly_queries", "document_queries", "evidence_queries", "map_queries", "measure_queries", "queries", "question_queries", "report_queries", "state_queries", "text_queries"]
