"""Every operator as a query over the test tables, with SQL to compare against."""

from . import cleaning, reports, shapes  # noqa: F401  (registration)
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
