"""Registered queries over the driver tables; importing this module fills the registry."""

from tablestats.plans import q_functions, q_grid, q_lookup, q_profile, q_rows, q_sources, q_stats  # noqa: F401
from tablestats.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
