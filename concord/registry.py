"""All queries of the library's own operators, with the SQL that each must agree with."""

from __future__ import annotations

from concord.plans import model_queries, source_queries  # noqa: F401  register their queries
from concord.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
