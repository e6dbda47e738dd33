"""All registered queries."""

from lexspan.plans import (  # noqa: F401
    activity_queries, audit_queries, metric_queries, oracle_parts, pool_queries, search_queries, source_queries,
    text_queries,
)
from lexspan.plans.registry import ORACLES, QUERIES  # noqa: F401
