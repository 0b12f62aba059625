"""All registered queries of the record library."""

from __future__ import annotations

import trove.plans.graph_queries  # noqa: F401
import trove.plans.record_queries  # noqa: F401
import trove.plans.service_queries  # noqa: F401
import trove.plans.sql_queries  # noqa: F401
import trove.plans.stream_queries  # noqa: F401
from trove.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    """Every query by name."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of those that SQL can express."""
    return dict(ORACLES)
