"""Queries over the driver's tables."""

from __future__ import annotations

from storyloom.bindings import aggregates, graphs, lifecycle, rows, text, windows  # noqa: F401
from storyloom.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
