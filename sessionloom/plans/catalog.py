"""All registered queries of the session analytics, with their SQL on DuckDB."""

from sessionloom.plans import event_queries, log_queries, report_queries, stream_queries, table_queries, text_queries  # noqa: F401  (they register themselves)
from sessionloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
