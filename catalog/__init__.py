"""Every operator bound to the generated tables, each with its SQL counterpart where SQL can express it."""

from catalog.registry import ORACLES, QUERIES
from catalog import cleaning, groups, modelling, profiles, round_trips, sampling, scores  # noqa: F401  (fill the registry)

__all__ = ["ORACLES", "QUERIES"]
