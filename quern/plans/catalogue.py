"""Named queries over the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from quern.plans import answer_queries, file_queries, number_queries, search_queries, store_queries, text_queries

FLAGSHIP = "bm25_topk_concat"
_MODULES = (text_queries, search_queries, answer_queries, number_queries, store_queries, file_queries)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
