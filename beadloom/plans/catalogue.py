"""Importing the query modules fills the registry."""

from . import bond_queries, coarse_queries, curve_queries, fit_queries, kernel_queries, matching_queries, source_queries, statistic_queries, stream_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
