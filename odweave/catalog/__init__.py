"""Every operator as a named query on the driver's tables, next to the SQL statement it must agree with."""

from odweave.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
