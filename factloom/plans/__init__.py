

from . import coverage_queries, geometry_queries, page_queries, proven_queries, queries as _queries, reader_queries, scale_queries, schedule_queries, statement_queries, value_queries  # noqa: E402, F401
from .registry import QUERIES, SQL  # noqa: E402


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
