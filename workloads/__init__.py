"""Every operator as a query over the provided tables, with the SQL that must give the same rows."""

from workloads import lineage, loading, models, open_sql, relational, results  # noqa: F401
from workloads.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
