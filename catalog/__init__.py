"""Queries over the driver tables: stand-in shapes, Spark queries and their SQL twins."""

from catalog import annotation_queries, box_queries, clock_queries, frame_queries, interval_queries, model_queries, source_queries

_PARTS = [
    clock_queries, interval_queries, annotation_queries, box_queries, frame_queries, model_queries, source_queries,
]

QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: text for part in _PARTS for name, text in part.ORACLES.items()}
