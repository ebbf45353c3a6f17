"""The query catalogue: each query as a DataFrame plan with its SQL check."""

from kith.plans.registry import ORACLES, QUERIES
from kith.plans import tables, retrieval, evaluation, flows  # noqa: F401  (they register themselves)

__all__ = ["ORACLES", "QUERIES"]
