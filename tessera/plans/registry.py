"""All queries of the library by name, with the SQL of those that have one."""

from __future__ import annotations

from tessera.plans import audits, cameras, choices, columns, derived, diagnoses, episodes, files, frames, packed, quantiles, relations, streams, summaries, tables, tpch, variants  # noqa: F401  each module registers its queries
from tessera.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
