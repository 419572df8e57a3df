"""Imports every check-query module so their ``register`` calls run."""

from segcast.plans import q_analytics, q_eval, q_features, q_forecast, q_panel, q_poisson  # noqa: F401
from segcast.plans import q_incremental, q_io  # noqa: F401  (reuses oracle texts registered above)
from segcast.plans.common import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
