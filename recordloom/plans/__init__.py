"""Complete plans: the import, and the registered queries."""

from recordloom.plans import (  # noqa: F401
    queries_records,
    queries_runlog,
    queries_tables,
    queries_values,
)
from recordloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
