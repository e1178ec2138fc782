"""Left join against a table with one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame


def lookup_join(rows: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """``rows LEFT JOIN lookup USING (key)`` where ``lookup`` holds each key once.

    With one row per key on the right, adaptive execution may split a hot key of ``rows`` over many tasks and
    give each of them the key's one row, so the plan is the same for any size.
    """
    return rows.join(lookup, key, "left")
