"""Registered queries, grouped by theme, with their check SQL."""

from ebbtide.catalog import drifting, evaluation, learning, quality
from ebbtide.catalog.learning import flagship
from ebbtide.catalog.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES", "drifting", "evaluation", "flagship", "learning", "quality"]
