"""All registered queries and their SQL."""

from __future__ import annotations

from . import details, documents, governance, learned, products  # noqa: F401  (they register their queries)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
