"""All queries of the engine and the SQL of those that SQL can express."""

from spanwright.plans import balancing, detection, evaluation, flows, scalars, sequences, sessions, synthesis  # noqa: F401
from spanwright.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
