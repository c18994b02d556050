"""All registered queries."""

from docspark.plans import answering, lookups, reports, retrieval, streams, structure, syncing  # noqa: F401
from docspark.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
