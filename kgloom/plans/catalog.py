"""All driver queries of the core library, with their SQL."""

from __future__ import annotations

from kgloom.plans import case_queries, corpus_queries, eval_queries, evidence_queries, fact_queries, governance_queries, graph_queries, io_queries, problems, run_queries, search_queries, table_queries, text_queries

_MODULES = (problems, fact_queries, graph_queries, corpus_queries, text_queries, eval_queries, io_queries, evidence_queries, table_queries, governance_queries, search_queries, case_queries, run_queries)

QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
SQL = {name: q for m in _MODULES for name, q in m.SQL.items()}
