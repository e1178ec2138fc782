"""Column-aware jobs on wide tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType

from ..fixed import COLUMN_TYPE_DEFAULT, COLUMN_TYPE_HINTS, TEMPLATES
from ..functions.text import q
from ..plans import deal, stage
from .allowlist import drop_allowed
from .registry import register
from .rewrite import anonymize, deanonymize, find_spans


def templates(spark: SparkSession) -> DataFrame:
    rows = [(n, t["description"], t["pii_columns"], t["keep_columns"]) for n, t in sorted(TEMPLATES.items())]
    return spark.createDataFrame(
        rows, "name string, description string, pii_columns array<string>, keep_columns array<string>"
    )


def template_columns(
    template: str | None = None, pii_columns: list[str] | None = None, keep_columns: list[str] | None = None
) -> tuple[list[str] | None, list[str] | None]:
    """Both lists of a template; an explicit list replaces the one of the template."""
    if template is None:
        return pii_columns, keep_columns
    if template not in TEMPLATES:
        raise ValueError(f"unknown template {template!r}, known: {', '.join(sorted(TEMPLATES))}")
    chosen = TEMPLATES[template]
    return pii_columns or chosen["pii_columns"], keep_columns or chosen["keep_columns"]


def target_columns(
    columns: list[str], pii_columns: list[str] | None = None, keep_columns: list[str] | None = None
) -> list[str]:
    """Columns to work on, names compared without case.

    ``pii_columns`` wins over ``keep_columns``; unknown names are ignored; with neither it is all columns.
    """
    if pii_columns:
        by_name = {c.lower(): c for c in columns}
        wanted = {by_name[c.lower()] for c in pii_columns if c.lower() in by_name}
        return [c for c in columns if c in wanted]
    if keep_columns:
        kept = {c.lower() for c in keep_columns}
        return [c for c in columns if c.lower() not in kept]
    return list(columns)


def column_type(column: str = "column") -> str:
    """SQL: type of a column by its name, hints in order."""
    cases = " ".join(
        "when " + " or ".join(f"contains(lower({column}), {q(w)})" for w in words) + f" then {q(t)}"
        for words, t in COLUMN_TYPE_HINTS
    )
    return f"case {cases} else {q(COLUMN_TYPE_DEFAULT)} end"


def string_columns(table: DataFrame) -> list[str]:
    return [f.name for f in table.schema.fields if isinstance(f.dataType, StringType)]


def cells(table: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """``(row_id, pos, column, value)`` of all non-blank cells of the given columns."""
    entries = ", ".join(f"struct({i} as pos, {q(c)} as column, `{c}` as value)" for i, c in enumerate(columns))
    return table.selectExpr(f"`{row_id}` as row_id", f"inline(array({entries}))").where(
        f"value rlike {q(r'(?U)[^\s]')}"
    )


def all_text_cells(tables: dict[str, DataFrame], row_ids: dict[str, str]) -> DataFrame:
    """``(table, row_id, column, value)`` over the string columns of all tables."""
    parts = [
        cells(t, row_ids[name], [c for c in string_columns(t) if c != row_ids[name]])
        .drop("pos")
        .select(F.lit(name).alias("table"), F.col("row_id").cast("string"), "column", "value")
        for name, t in tables.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def distinct_cells(all_cells: DataFrame) -> DataFrame:
    """Distinct cell values as documents, in order of first appearance (row, then column).

    A value in a third of all cells is worked on once.
    """
    first = F.min(F.struct("row_id", "pos", "column")).alias("f")
    return (
        all_cells.groupBy("value")
        .agg(first)
        .selectExpr("value as doc_id", "struct(f.row_id as row_id, f.pos as pos) as ord", "f.column as column", "value as text")
    )


def put_back(table: DataFrame, row_id: str, columns: list[str], mapping: DataFrame) -> DataFrame:
    """Replace cells by ``mapping(value, new_value)``; cells without an entry stay.

    All columns go through one join: the cells of a row are unpivoted, meet the mapping, and the changed ones
    come back to their row as one small map. The plan reads the table twice, whatever the number of columns.
    """
    if not columns:
        return table
    changed = (
        cells(table, row_id, columns)
        .join(mapping.select("value", "new_value"), "value")
        .groupBy(F.col("row_id").alias("_row"))
        .agg(F.map_from_entries(F.collect_list(F.struct("pos", "new_value"))).alias("_new"))
    )
    joined = table.join(changed, F.col(f"`{row_id}`") == F.col("_row"), "left")
    place = {c: i for i, c in enumerate(columns)}
    return joined.select(
        *[
            F.coalesce(F.expr(f"_new[{place[c]}]"), F.col(f"`{c}`")).alias(c) if c in place else F.col(f"`{c}`")
            for c in table.columns
        ]
    )


def as_text(table: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """``table`` with the target columns as strings: in the rewritten table a number or date is text.

    The row id and columns of nested types can't be rewritten and raise ``ValueError``.
    """
    if row_id in columns:
        raise ValueError(f"{row_id!r} identifies the rows and can't be a target; give the table another row id")
    nested = [c for c in columns if isinstance(table.schema[c].dataType, (ArrayType, MapType, StructType))]
    if nested:
        raise ValueError(f"columns of nested types can't be targets: {', '.join(nested)}")
    texts = set(string_columns(table))
    return table.withColumns({c: F.col(f"`{c}`").cast("string") for c in columns if c not in texts})


def register_table(
    table: DataFrame, row_id: str, distinct: DataFrame, registry: DataFrame, case_id: str, **options
) -> DataFrame:
    """Registry of the case after a column-aware run; ``distinct`` are the distinct target cells.

    1. The text of every row, kept columns and columns of other types included, is detected and registered.
    2. Target cells with a detected value register that value; all other target cells of at least two
       characters register as a whole, with the type of their column (blind mode).

    ``options`` are those of ``find_spans``; allowlist and type filter also hold for whole cells.
    """
    texts = [
        f.name for f in table.schema.fields
        if f.name != row_id and not isinstance(f.dataType, (ArrayType, MapType, StructType))
    ]
    lines = table.selectExpr(
        f"`{row_id}` as doc_id", f"struct(`{row_id}` as row_id, -1 as pos) as ord",
        "concat_ws(',', " + ", ".join(f"cast(`{c}` as string)" for c in texts) + ") as text",
    )
    first = find_spans(deal(lines, "doc_id", table.count()), case_id, **options)
    grown = registry.unionByName(register(first, registry, case_id))
    known = grown.where(F.col("case_id") == case_id).selectExpr("raw_value as doc_id")
    open_cells = distinct.join(known, "doc_id", "left_anti")
    # a cell with a listed value inside is no whole value either
    inner = stage(find_spans(open_cells, case_id, **{**options, "allowlist": None}), "cell-spans")
    blind = (
        open_cells.join(inner.select("doc_id").distinct(), "doc_id", "left_anti")
        .where("length(trim(text)) >= 2")
        .selectExpr(
            "doc_id", "ord", "0 as start", "length(text) as end", "text as raw_value",
            f"{column_type()} as pii_type", "1.0D as confidence",
        )
    )
    if options.get("include"):
        blind = blind.where(F.col("pii_type").isin(options["include"]))
    if options.get("exclude"):
        blind = blind.where(~F.col("pii_type").isin(options["exclude"]))
    second = inner.select(blind.columns).unionByName(blind)
    if options.get("allowlist") is not None:
        second = drop_allowed(second, options["allowlist"], case_id)
    return grown.unionByName(register(second, grown, case_id))


def anonymize_table(
    table: DataFrame,
    row_id: str,
    registry: DataFrame,
    case_id: str,
    *,
    template: str | None = None,
    pii_columns: list[str] | None = None,
    keep_columns: list[str] | None = None,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """Column-aware pseudonymization; returns the rewritten table and the grown registry.

    A cell that is a registered value becomes its token; any other target cell has the registered
    values inside it replaced. Targets of other types are rewritten as text. Without a list of columns all but
    the row id are targets. ``options`` are those of ``find_spans`` (allowlist, further spans, types, entropy).
    """
    pii, keep = template_columns(template, pii_columns, keep_columns)
    columns = target_columns(table.columns, pii, keep)
    if not pii:
        columns = [c for c in columns if c != row_id]
    texts = as_text(table, row_id, columns)
    distinct = stage(distinct_cells(cells(texts, row_id, columns)), "cells")
    grown = register_table(texts, row_id, distinct, registry, case_id, **options)
    return _replaced(texts, row_id, columns, distinct, grown, case_id, whole_first=True), grown


def replace_cells(
    table: DataFrame, row_id: str, columns: list[str], registry: DataFrame, case_id: str
) -> DataFrame:
    """Replace registered values in the target columns; nothing new is registered."""
    texts = as_text(table, row_id, columns)
    distinct = stage(distinct_cells(cells(texts, row_id, columns)), "cells")
    return _replaced(texts, row_id, columns, distinct, registry, case_id)


def _replaced(
    table: DataFrame, row_id: str, columns: list[str], distinct: DataFrame, registry: DataFrame, case_id: str,
    whole_first: bool = False,
) -> DataFrame:
    texts = distinct.select("doc_id", "text")
    known = registry.where(F.col("case_id") == case_id).selectExpr("raw_value as value", "token")
    if whole_first:
        # whole values need no search inside the cell
        whole = texts.withColumnRenamed("doc_id", "value").join(known, "value").selectExpr("value", "token as new_value")
        texts = texts.join(known.selectExpr("value as doc_id"), "doc_id", "left_anti")
    new = anonymize(texts, registry, case_id).selectExpr("doc_id as value", "text as new_value")
    new = new.where("new_value <> value")
    return put_back(table, row_id, columns, stage(new.unionByName(whole) if whole_first else new, "new-cells"))


def rewrite_cells(table: DataFrame, columns: list[str], change: Callable[[Column, str], Column]) -> DataFrame:
    """Target columns rewritten by an own function ``change(cell, column name)``; names compare without case.

    The function gets and gives a column, so it runs inside the scan like any other expression.
    """
    return table.withColumns({c: change(F.col(f"`{c}`"), c) for c in target_columns(table.columns, columns)})


def restore_table(
    table: DataFrame,
    row_id: str,
    registry: DataFrame,
    case_id: str,
    columns: list[str],
    only_types: list[str] | None = None,
) -> DataFrame:
    """Tokens in the target columns back to raw values."""
    distinct = distinct_cells(cells(table, row_id, columns).where("contains(value, 'ANON')"))
    back = deanonymize(stage(distinct.select("doc_id", "text"), "cells"), registry, case_id, only_types)
    new = back.selectExpr("doc_id as value", "text as new_value").where("new_value <> value")
    return put_back(table, row_id, columns, stage(new, "new-cells"))


def replace_database(
    tables: dict[str, DataFrame], row_ids: dict[str, str], registry: DataFrame, case_id: str
) -> dict[str, DataFrame]:
    """Every string column of every table rewritten, all other columns as they are."""
    return {
        name: replace_cells(
            t, row_ids[name], [c for c in string_columns(t) if c != row_ids[name]], registry, case_id
        )
        for name, t in tables.items()
    }
