"""Queries of the operators bound to the supplied Parquet tables, each with its SQL counterpart."""

from standin_queries.base import ORACLE, QUERIES  # noqa: F401
from standin_queries import buildings, energy, learning, meters, sources, space, streams, tables  # noqa: F401,E402
