"""Named queries over the star-schema tables, each next to its SQL check."""

from dailycast.catalog import facts, features, forecasts, models, projections  # noqa: F401
from dailycast.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
