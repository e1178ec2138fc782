"""Allowlist: values and domains that are never replaced. Plus its state operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import after_first_at, normal_domain, q
from ..plans.staging import stage


def drop_allowed(spans: DataFrame, allowlist: DataFrame, case_id: str) -> DataFrame:
    """Spans whose value, mail domain or host domain is not on the allowlist of the case.

    All three tests are equi-joins: the span gives every key under which it could be listed. The spans are staged, as
    they are read twice and mostly come from a detection.
    """
    spans = stage(spans, "spans")
    listed = allowlist.where(F.col("case_id") == case_id)
    entries = (
        listed.selectExpr("concat('v:', lower(value)) as k")
        .unionByName(listed.where("value_type = 'domain'").selectExpr("concat('d:', lower(value)) as k"))
        .distinct()
    )
    host = "regexp_replace(lower(raw_value), '^[.]+', '')"
    labels = f"split({host}, '[.]')"
    # the host itself and every part of it after a dot
    suffixes = (
        f"transform(sequence(1, size({labels})), i -> concat('d:', array_join(slice({labels}, i, size({labels})), '.')))"
    )
    mail = f"concat('d:', {after_first_at('lower(raw_value)')})"
    keys = (
        "array_compact(concat(array(concat('v:', lower(raw_value))), "
        f"if(pii_type = 'email', array({mail}), array()), if(pii_type = 'hostname', {suffixes}, array())))"
    )
    # distinct values first: a value that fills a third of the rows is looked up once
    values = spans.select("raw_value", "pii_type").distinct()
    allowed = (
        values.selectExpr("raw_value", "pii_type", f"explode({keys}) as k")
        .join(entries, "k", "left_semi")
        .select("raw_value", "pii_type")
        .distinct()
    )
    return spans.join(allowed, ["raw_value", "pii_type"], "left_anti")


def add_entries(allowlist: DataFrame, entries: DataFrame) -> DataFrame:
    """Add ``entries(case_id, value, value_type, reason, n)``; a later entry replaces an earlier one."""
    old = allowlist.withColumn("n", F.lit(-1).cast("bigint"))
    last = F.max(F.struct("n", "value_type", "reason")).alias("e")
    return (
        old.unionByName(entries.withColumn("n", F.col("n").cast("bigint")))
        .groupBy("case_id", "value")
        .agg(last)
        .selectExpr("case_id", "value", "e.value_type as value_type", "e.reason as reason")
    )


def domain_entries(domains: DataFrame, case_id: str, reason: str = "") -> DataFrame:
    """Allowlist rows for ``domains(n, value)`` in stored form."""
    return domains.selectExpr(
        f"{q(case_id)} as case_id", f"{normal_domain('value')} as value", "'domain' as value_type",
        f"{q(reason)} as reason", "n",
    )


def ioc_entries(values: DataFrame, case_id: str, value_type: str = "ioc", reason: str = "") -> DataFrame:
    """Allowlist rows for imported ``values(n, value)``."""
    return values.selectExpr(
        f"{q(case_id)} as case_id", "value", f"{q(value_type)} as value_type", f"{q(reason)} as reason", "n"
    )


def remove_entries(allowlist: DataFrame, values: DataFrame) -> DataFrame:
    """Drop ``values(case_id, value)``."""
    return allowlist.join(values, ["case_id", "value"], "left_anti")


def members(values: DataFrame, allowlist: DataFrame, case_id: str) -> DataFrame:
    """Rows of ``values(value)`` listed exactly as written."""
    listed = allowlist.where(F.col("case_id") == case_id).select("value").distinct()
    return values.join(listed, "value", "left_semi")


def clean_values(lines: DataFrame) -> DataFrame:
    """Values of ``lines(n, value)``: trimmed, no blanks, no ``#`` lines, first of equal ones."""
    trimmed = lines.selectExpr("n", f"regexp_replace(value, {q(r'(?U)^\s+|\s+$')}, '') as value")
    return (
        trimmed.where("value <> '' and not startswith(value, '#')")
        .groupBy("value")
        .agg(F.min("n").alias("n"))
        .select("n", "value")
    )


def pending_files(files: DataFrame, ledger: DataFrame, case_id: str, direction: str) -> DataFrame:
    """``files(path, …)`` that the ledger does not hold for this case and direction."""
    done = ledger.where((F.col("case_id") == case_id) & (F.col("direction") == direction)).select("path")
    return files.join(done, "path", "left_anti")


def mark_processed(ledger: DataFrame, rows: DataFrame) -> DataFrame:
    """Upsert on ``(case_id, path, direction)``: the newest row stays."""
    last = F.max(F.struct("processed_at", "file_hash")).alias("r")
    return (
        ledger.unionByName(rows)
        .groupBy("case_id", "path", "direction")
        .agg(last)
        .selectExpr("case_id", "path", "direction", "r.file_hash as file_hash", "r.processed_at as processed_at")
    )
