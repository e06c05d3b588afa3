"""Operators for training-data pipelines.  Nothing outside this package imports it."""

from provlake.llm.queries import ORACLES, QUERIES  # noqa: F401
