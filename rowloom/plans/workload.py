"""All queries over the given tables and the SQL counterparts of those that SQL can express."""

from rowloom.plans import model_queries, prep_queries, report_queries, vector_queries

_MODULES = (vector_queries, prep_queries, report_queries, model_queries)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
