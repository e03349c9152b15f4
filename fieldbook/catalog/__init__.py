"""All registered queries."""

from fieldbook.catalog import cleaning, history, modelling, sources, statistics  # noqa: F401
from fieldbook.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
