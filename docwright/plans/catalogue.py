"""All queries of the library and their SQL."""

from . import finance, observability, promql_queries, provenance, records, relational, retrieval, sources, structure, text  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
