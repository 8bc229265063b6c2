"""Registered queries and their SQL: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from . import funnel_queries, graph_queries, more_queries, note_queries, store_queries, study_queries, text_queries, vector_queries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

for _part in (vector_queries, funnel_queries, graph_queries, text_queries, note_queries, more_queries, store_queries, study_queries):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
