"""Corpora and tables from files, and back to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed import TABLE_EXTENSIONS
from ..operators.allowlist import clean_values
from ..operators.reports import file_formats
from ..plans import sequence_table, with_dense_number
from .files import list_tree, with_content
from .tables import read_delimited

_TEXT = (
    "if(is_valid_utf8(cast(content as string)), cast(content as string), decode(content, 'ISO-8859-1'))"
)


def list_files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """``files(path, length)``, path relative to ``root``: every file, also empty ones and names like ``_x`` and ``.x``."""
    return list_tree(spark, root, recursive)


def read_corpus(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """``docs(doc_id, ord, path, text, file_hash)`` of all supported files, in path order.

    UTF-8, or Latin-1 where the bytes are not valid UTF-8. Paths are ordered part by part, so a folder comes
    before a file whose name goes on after the folder's. The order is numbered over the paths alone; contents are
    read afterwards, where they are used, and never shuffled.
    """
    files = file_formats(list_files(spark, root, recursive)).where("adapter is not null")
    parts = files.selectExpr("path", "length", "split(path, '/') as parts")
    order = with_dense_number(sequence_table(parts, ["parts"], "paths"), "ord").select("path", "length", "ord")
    return with_content(order, root).selectExpr(
        "path as doc_id", "ord", "path", f"{_TEXT} as text", "sha2(content, 256) as file_hash"
    )


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV or TSV with header, all strings, with ``row_id`` in file order; an empty cell is an empty string.

    Quoted cells may hold line breaks; large files are read by many tasks all the same. Several files are ordered by name.
    """
    return read_delimited(spark, path, TABLE_EXTENSIONS["." + path.rsplit(".", 1)[-1].lower()])


def _in_file_order(rows: DataFrame, name: str) -> DataFrame:
    """Number rows by file name and place in the file; ``name`` comes first."""
    columns = rows.columns
    placed = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at"))
    seq = sequence_table(placed, ["_file", "_at"], "file-rows")
    return with_dense_number(seq, name, base=-1).select(name, *columns)


def write_corpus(docs: DataFrame, out: str, case_id: str) -> None:
    """Rewritten documents as a new table with their path; an existing output is never replaced."""
    docs.withColumn("case_id", F.lit(case_id)).write.partitionBy("case_id").mode("errorifexists").parquet(out)


def write_bucketed_corpus(docs: DataFrame, table: str, buckets: int) -> None:
    """Documents bucketed by ``doc_id``.

    Jobs that bring results back to their text join on ``doc_id``; on a bucketed table the texts stay in
    place and only the small side moves.
    """
    docs.write.bucketBy(buckets, "doc_id").sortBy("doc_id").saveAsTable(table)


def read_values(spark: SparkSession, path: str, column: int = 0) -> DataFrame:
    """``(n, value)`` of a value list: one per line, or one column of a CSV file (cells may hold line breaks)."""
    if path.lower().endswith(".csv"):
        lines = spark.read.csv(path, header=False, quote='"', escape='"', multiLine=True).selectExpr(f"_c{column} as value")
    else:
        lines = spark.read.text(path).select("value")
    return clean_values(_in_file_order(lines, "n"))
