"""Registered queries and their SQL checks."""

from .registry import ORACLES, QUERIES
from . import columns, corpora, detection, evidence, jobs, linking, reports, rewriting  # noqa: F401  (fill both tables)

__all__ = ["ORACLES", "QUERIES"]
