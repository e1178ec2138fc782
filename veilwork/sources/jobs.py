"""Whole-folder jobs: list, skip what is done, rewrite, write, remember, sum up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import q
from ..operators.allowlist import mark_processed, pending_files
from ..operators.reports import file_formats
from ..operators.rewrite import anonymize_corpus, deanonymize, find_spans
from ..plans.staging import stage
from .corpus import list_files, read_corpus
from .files import write_files
from .state import commit_state, load_state


def _finish(
    spark: SparkSession, root: str, rewritten: DataFrame, out: str, state: dict, case_id: str, direction: str, recursive: bool
) -> tuple[dict, DataFrame]:
    """Write the texts, mark them in the ledger, and give the state and a summary row per file."""
    write_files(rewritten, out)
    marks = rewritten.selectExpr(
        f"{q(case_id)} as case_id", "path", f"{q(direction)} as direction", "file_hash", "current_timestamp() as processed_at"
    )
    ledger = stage(mark_processed(state["ledger"], marks), "ledger")
    files = file_formats(list_files(spark, root, recursive)).select("path", "length", "adapter")
    status = "case when adapter is null then 'unsupported' when n_hits is null then 'done before' else 'processed' end"
    summary = files.join(rewritten.select("path", "n_hits"), "path", "left").selectExpr(
        "path", "length", f"{status} as status", "coalesce(n_hits, 0L) as n_hits"
    )
    return {**state, "ledger": ledger}, summary


def anonymize_files(
    spark: SparkSession, root: str, out: str, state: dict[str, DataFrame], case_id: str, *, recursive: bool = True,
    **options,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Anonymize the supported files under ``root`` that the ledger doesn't hold yet, to the same paths under ``out``.

    ``state`` has the tables of ``empty_case``; its allowlist holds for the job. ``options`` are those of
    ``find_spans``. Returns the grown state and ``(path, length, status, n_hits)`` for every file.
    """
    docs = read_corpus(spark, root, recursive)
    fresh = stage(pending_files(docs, state["ledger"], case_id, "anonymize"), "fresh-files")
    spans = find_spans(fresh, case_id, allowlist=state["allowlist"], **options)
    rewritten, registry = anonymize_corpus(fresh, spans, state["registry"], case_id)
    rewritten = stage(rewritten, "rewritten-files")
    return _finish(spark, root, rewritten, out, {**state, "registry": registry}, case_id, "anonymize", recursive)


def restore_files(
    spark: SparkSession, root: str, out: str, state: dict[str, DataFrame], case_id: str, *,
    only_types: list[str] | None = None, recursive: bool = True,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Put raw values back into the files under ``root``; the same results as ``anonymize_files``."""
    docs = read_corpus(spark, root, recursive)
    fresh = stage(pending_files(docs, state["ledger"], case_id, "deanonymize"), "fresh-files")
    restored = stage(deanonymize(fresh, state["registry"], case_id, only_types), "restored-files")
    return _finish(spark, root, restored, out, state, case_id, "deanonymize", recursive)


def anonymize_folder(
    spark: SparkSession, root: str, out: str, state_dir: str, case_id: str, *, recursive: bool = True, **options
) -> DataFrame:
    """``anonymize_files`` on a state kept in ``state_dir``; returns the summary.

    Registry, ledger and the rest of the state change together, after all files are written. A run that fails anywhere
    is simply repeated: it starts from the same state, so it gives the same tokens, and files that it has written
    already count as written.
    """
    number, state = load_state(spark, state_dir)
    state, summary = anonymize_files(spark, root, out, state, case_id, recursive=recursive, **options)
    commit_state(spark, state_dir, state, number)
    return summary


def restore_folder(
    spark: SparkSession, root: str, out: str, state_dir: str, case_id: str, *, only_types: list[str] | None = None,
    recursive: bool = True,
) -> DataFrame:
    """``restore_files`` on a state kept in ``state_dir``; returns the summary."""
    number, state = load_state(spark, state_dir)
    state, summary = restore_files(spark, root, out, state, case_id, only_types=only_types, recursive=recursive)
    commit_state(spark, state_dir, state, number)
    return summary
