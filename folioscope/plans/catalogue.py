"""All queries of the region, transcription and dataset operators, and their DuckDB SQL."""

from folioscope.plans import box_queries, corpus_queries, file_queries, flow_queries, match_queries, text_queries
from folioscope.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "box_queries", "corpus_queries", "file_queries", "flow_queries", "match_queries", "text_queries"]
