"""Rewrite jobs: anonymize documents with registry tokens and restore them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import q
from .allowlist import drop_allowed
from .detect import detect
from .dictionary import replace_hits
from .registry import register, replacement_entries

TOKEN = "^ANON[A-Z]+[0-9]{3,}$"


def anonymize(docs: DataFrame, registry: DataFrame, case_id: str) -> DataFrame:
    """``docs`` with every registered value replaced by its token, plus ``n_hits``."""
    return replace_hits(docs, replacement_entries(registry, case_id), "token")


def find_spans(
    docs: DataFrame,
    case_id: str,
    *,
    allowlist: DataFrame | None = None,
    extra: Callable[[DataFrame], DataFrame] | None = None,
    include: list[str] | None = None,
    exclude: list[str] | None = None,
    min_entropy: float = 3.5,
) -> DataFrame:
    """Spans that a job registers: detected, unprotected, not on the allowlist of the case.

    ``extra`` gives further spans of the documents (word lists, own rules); ``include`` and ``exclude`` are types.
    """
    spans = detect(
        docs, protect=True, include=include, exclude=exclude, min_entropy=min_entropy,
        extra_spans=extra(docs) if extra else None, context=False,
    ).drop("left_ctx", "right_ctx")
    return spans if allowlist is None else drop_allowed(spans, allowlist, case_id)


def anonymize_corpus(
    docs: DataFrame, spans: DataFrame, registry: DataFrame, case_id: str
) -> tuple[DataFrame, DataFrame]:
    """Two passes: register every value of the corpus, then replace all of them everywhere.

    Returns the rewritten documents and the full registry of the case.
    """
    grown = registry.unionByName(register(spans, registry, case_id))
    return anonymize(docs, grown, case_id), grown


def deanonymize(
    docs: DataFrame, registry: DataFrame, case_id: str, only_types: list[str] | None = None
) -> DataFrame:
    """Whole-word tokens back to raw values; unknown tokens stay.

    With ``only_types`` only tokens of these types are restored (an empty list restores nothing).
    """
    known = registry.where(F.col("case_id") == case_id)
    if only_types is not None:
        known = known.where(F.col("pii_type").isin(only_types))
    tokens = known.selectExpr("token as variant", "raw_value")
    return replace_hits(docs, tokens, "raw_value", "contains(text, 'ANON')", f"{{word}} rlike {q(TOKEN)}")
