"""All queries of the core and their SQL twins."""

from nordlys.plans import check_queries, label_queries, source_queries, text_queries

MODULES = (text_queries, label_queries, source_queries, check_queries)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
