"""Registered queries over the driver's tables."""

from . import elementwise, formats, relational, statistics  # noqa: F401  (each registers its queries)
from .tables import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
