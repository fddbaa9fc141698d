"""Queries of the training-data operators, by name, and SQL where it can express them."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}
