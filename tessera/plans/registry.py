"""All queries by name, and their DuckDB SQL."""

from __future__ import annotations

from tessera.plans import panels, strategies, suite, texts, universes  # noqa: F401  they register themselves
from tessera.plans.catalogue import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
