"""All queries."""

from quorumlake.plans import changes, flows, queries, values  # noqa: F401  they register their queries
from quorumlake.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
