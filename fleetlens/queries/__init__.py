"""Registered queries over the given tables, each with its SQL twin where one exists."""

from __future__ import annotations

from fleetlens.queries.registry import all_oracles, all_queries

__all__ = ["all_oracles", "all_queries"]
