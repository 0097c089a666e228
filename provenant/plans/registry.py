"""All registered queries of the library proper and their SQL counterparts."""

from provenant.plans import events_queries, ledger_queries, more_queries, record_queries, region_queries, relation_queries, source_queries, text_queries

PARTS = (events_queries, relation_queries, text_queries, more_queries, region_queries, ledger_queries, record_queries, source_queries)
QUERIES = {name: query for part in PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
