"""All registered queries: importing a module registers its queries."""

from __future__ import annotations

from lotwise.plans import (  # noqa: F401
    column_queries, metric_queries, model_queries, quality_queries, source_queries, stats_queries,
)
from lotwise.plans.catalog import ORACLES, QUERIES  # noqa: F401
