"""The registered queries and their SQL, gathered from the modules by topic."""

from sparkloom.plans import analytics_queries, document_queries, extraction_queries, relational_queries, retrieval_queries, search_queries, text_queries

hybrid_linear = retrieval_queries.hybrid_linear

QUERIES = {}
ORACLE_SQL = {}
for _module in (analytics_queries, relational_queries, retrieval_queries, document_queries, extraction_queries, search_queries, text_queries):
    QUERIES.update(_module.QUERIES)
    ORACLE_SQL.update(_module.ORACLE_SQL)
