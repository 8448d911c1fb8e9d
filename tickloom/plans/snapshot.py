"""All features of every bar, and one row for each symbol's newest bar with the structure around it."""

from __future__ import annotations

from .asof import features, newest, regimes

__all__ = ["features", "newest", "regimes"]
