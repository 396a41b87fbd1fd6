"""Queries over the given tables; importing this package fills the registry."""

from tessella.catalog import claims, files, models, profiles, text, traffic  # noqa: F401
from tessella.catalog.base import ORACLES, QUERIES, Tables

__all__ = ["ORACLES", "QUERIES", "Tables"]
