"""Importing this package registers every query."""

from gridrisk.catalog import community, devices, explore, files, parcels, threat  # noqa: F401
from gridrisk.catalog.registry import QUERIES, oracles

__all__ = ["QUERIES", "oracles"]
