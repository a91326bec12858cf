"""Importing this module registers every query."""

from tunekit.catalog import data, log, models, proposals, search, validation  # noqa: F401
from tunekit.catalog.models import flagship
from tunekit.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]
