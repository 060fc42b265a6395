"""Independent SQL for the registered queries, on the same tables."""

from oracles.queries import ORACLES

__all__ = ["ORACLES"]
