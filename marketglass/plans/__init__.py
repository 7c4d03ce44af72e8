"""Registered queries over the test tables, and their SQL."""

from . import business_queries, catalog_queries, planning_queries, price_queries, state_queries, stream_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
