"""Reports on a case, a scan and a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed import TABLE_EXTENSIONS, TEXT_EXTENSIONS
from ..functions.text import in_list, q, shortened


def scan_report(spans: DataFrame) -> DataFrame:
    """Spans with 20 characters of context on each side, newlines as blanks."""
    context = "translate(concat(right(left_ctx, 20), raw_value, left(right_ctx, 20)), '\n', ' ')"
    return spans.selectExpr("doc_id", "start", "pii_type", "raw_value", "confidence", f"{context} as context")


def scan_totals(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Matches per document and type, plus the grand total and the number of documents scanned."""
    per_type = spans.groupBy(F.col("doc_id").cast("string").alias("doc"), "pii_type").agg(F.count("*").alias("n"))
    total = spans.agg(F.count("*").alias("n")).selectExpr("'(all)' as doc", "'(matches)' as pii_type", "n")
    scanned = docs.agg(F.count("*").alias("n")).selectExpr("'(all)' as doc", "'(documents)' as pii_type", "n")
    return per_type.unionByName(total).unionByName(scanned)


def mappings_by_type(registry: DataFrame, case_id: str) -> DataFrame:
    known = registry.where(F.col("case_id") == case_id)
    return known.groupBy("pii_type").agg(F.count("*").alias("n")).orderBy("pii_type")


def case_status(registry: DataFrame, ledger: DataFrame, allowlist: DataFrame, case_id: str) -> DataFrame:
    """One row: mappings, entities, processed files, allowlist entries."""
    mine = F.col("case_id") == case_id
    return registry.where(mine).agg(
        F.count("*").alias("total_mappings"),
        F.countDistinct("entity_id").alias("total_entities"),
        ledger.where(mine).agg(F.count("*")).scalar().alias("processed_files"),
        allowlist.where(mine).agg(F.count("*")).scalar().alias("allowlist_entries"),
    )


def mapping_listing(registry: DataFrame, case_id: str) -> DataFrame:
    """Mappings by entity and type, long values shortened."""
    known = registry.where(F.col("case_id") == case_id)
    return known.selectExpr(
        "entity_id", "pii_type", "token", f"{shortened('raw_value')} as value", "mapping_id"
    ).orderBy("entity_id", "pii_type", "mapping_id")


def file_formats(files: DataFrame) -> DataFrame:
    """``files(path)`` with ``extension`` and ``adapter`` (text, table or null when unsupported)."""
    extension = f"lower(regexp_extract(path, {q(r'[^/.](\.[^/.]+)$')}, 1))"
    return files.withColumn("extension", F.expr(extension)).withColumn(
        "adapter",
        F.expr(
            f"case when {in_list('extension', TEXT_EXTENSIONS)} then 'text' "
            f"when {in_list('extension', list(TABLE_EXTENSIONS))} then 'table' end"
        ),
    )


def run_summary(files: DataFrame, done: DataFrame, output_root: str, status: str = "anonymized") -> DataFrame:
    """Status of every listed file; ``done(path)`` are files processed in an earlier run.

    Only anonymizing looks at earlier runs; restoring is always done again.
    """
    rows = file_formats(files)
    if status == "anonymized":
        rows = rows.join(done.select("path").distinct().withColumn("_done", F.lit(True)), "path", "left")
    else:
        rows = rows.withColumn("_done", F.lit(False))
    skipped = "adapter is null or coalesce(_done, false)"
    return rows.selectExpr(
        "path",
        f"if({skipped}, 'skipped', {q(status)}) as status",
        "case when adapter is null then 'unsupported format' when coalesce(_done, false) then 'already processed' "
        "end as reason",
        f"if({skipped}, null, concat({q(output_root.rstrip('/') + '/')}, path)) as output",
    )


def summary_totals(summary: DataFrame) -> DataFrame:
    return summary.groupBy("status", "reason").agg(F.count("*").alias("n"))
