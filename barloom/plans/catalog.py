"""Every registered query of the core library with its DuckDB equivalent."""

from __future__ import annotations

from . import bars, bets, joins, labels, models, series, weights  # noqa: F401  (they register themselves)
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
