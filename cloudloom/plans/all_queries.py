"""All queries of the point-cloud and mesh operators."""

from cloudloom.plans import more_queries  # noqa: F401  (registers its queries)
from cloudloom.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
