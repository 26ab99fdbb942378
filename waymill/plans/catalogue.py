"""All queries of the core and the SQL that checks them."""

from waymill.plans import geometry_queries, graph_queries, map_queries, problems, relational_queries, routing_queries, sequence_queries, source_queries, spatial_queries, stream_queries, text_queries

_MODULES = (problems, geometry_queries, relational_queries, spatial_queries, graph_queries, routing_queries, map_queries, sequence_queries, text_queries, source_queries, stream_queries)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
