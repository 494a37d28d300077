"""All registered queries; importing a module registers its queries."""

from pulsewarden.plans import (  # noqa: F401
    aggregate_queries, alert_queries, detector_queries, scalar_queries, source_queries, window_queries,
)
from pulsewarden.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
