"""Registered queries."""

from . import blending, catalogs, loading, ordering, quality, series, texts  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
