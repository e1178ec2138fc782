"""Delimited files with a header, read by many tasks whatever their size.

Quoted cells may hold line breaks, so a line break ends a row only after an even number of quotes. The quotes of each
block of a file are counted in one job; sums over the blocks before tell whether a block begins inside a cell; then
every task cuts its block at true row ends. A row belongs to the block it begins in, and is read to its end from there.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans import sequence_table, stage, with_dense_number
from .files import list_tree, open_store, store_uri

#: Bytes of a block, and rows of an output batch.
BLOCK_BYTES, BATCH_ROWS = 32 << 20, 1 << 13
_QUOTE, _BREAK = 34, 10


def _decoded(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _rows(data: bytes, sep: str) -> Iterator[list[str]]:
    """Rows of whole lines; blank lines are none."""
    return (row for row in csv.reader(io.StringIO(_decoded(data), newline=""), delimiter=sep) if row)


def _stray(data: np.ndarray, sep: int) -> bool:
    """Whether a quote stands inside a cell that isn't quoted; then counting quotes says nothing."""
    at = np.flatnonzero(data[1:-1] == _QUOTE) + 1
    edge = np.zeros(256, bool)
    edge[[sep, _BREAK, 13, _QUOTE, 0]] = True
    return bool((~edge[data[at - 1]] & ~edge[data[at + 1]]).any())


def _row_ends(data: bytes, inside: bool) -> np.ndarray:
    """Places behind the line breaks that end a row."""
    b = np.frombuffer(data, np.uint8)
    closed = (np.cumsum(b == _QUOTE, dtype=np.uint8) + np.uint8(inside)) & 1 == 0
    return np.flatnonzero((b == _BREAK) & closed) + 1


def _segment(f, size: int, start: int, end: int, inside: bool) -> bytes:
    """The rows that begin in ``start .. end``, read to the end of the last."""
    f.seek(max(start - 1, 0))
    data = f.read(end - max(start - 1, 0))
    first = 0
    if start:
        # the byte before the block comes along: it may end a row; a quote there was counted already
        ends = _row_ends(data, inside ^ (data[:1] == b'"'))
        if not len(ends) or ends[0] >= len(data):
            return b""  # no row begins here
        first = int(ends[0])
    odd = (inside ^ (start > 0 and data[:1] == b'"')) ^ (data.count(b'"') % 2 == 1)
    if data[-1:] == b"\n" and not odd:
        return data[first:]
    more = [data[first:]]
    while end < size:
        part = f.read(min(1 << 20, size - end))
        ends = _row_ends(part, odd)
        if len(ends):
            more.append(part[: ends[0]])
            break
        more.append(part)
        odd ^= part.count(b'"') % 2 == 1
        end += len(part)
    return b"".join(more)


def safe_names(header: list[str]) -> list[str]:
    """Column names: without a name by place, repeated ones (also in other case) with their place."""
    low = [h.lower() for h in header]
    return [f"_c{i}" if not h else f"{h}{i}" if low.count(low[i]) > 1 else h for i, h in enumerate(header)]


def read_delimited(spark: SparkSession, path: str, sep: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``row_id`` (from 0, in file order) and all columns as strings, of one file or of all files in a folder.

    The first file's header names the columns, every file's first row is its header. Short rows are filled with empty
    cells, further cells are left out. A file in which quotes stand inside unquoted cells is read by one task, as a
    stream. Bytes are UTF-8, blocks that aren't are read as Latin-1.
    """
    uri = store_uri(spark, path)
    store, base = open_store(uri)
    if store.get_file_info(base).type == fs.FileType.Directory:
        files = list_tree(spark, path).where("length > 0")
    else:
        files = spark.createDataFrame([("", store.get_file_info(base).size)], "path string, length long")
    sign = ord(sep)

    def opened(name: str):
        own, root = open_store(uri)
        return own.open_input_file(f"{root}/{name}" if name else root)

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            found = []
            for name, length, block in zip(*(p.column(i).to_pylist() for i in range(3)), strict=True):
                with opened(name) as f:
                    start = block * block_bytes
                    f.seek(max(start - 1, 0))
                    data = f.read(min(block_bytes, length - start) + 1 + (start > 0))
                    data = (b"" if start else b"\n") + data + (b"\n" if start + block_bytes >= length else b"")
                body = data[1:-1]
                found.append((name, length, block, body.count(b'"') % 2, _stray(np.frombuffer(data, np.uint8), sign)))
            if found:
                yield pa.RecordBatch.from_pydict(dict(zip(("path", "length", "block", "odd", "stray"), zip(*found, strict=True), strict=True)))

    last = F.ceil(F.col("length") / block_bytes) - 1
    blocks = files.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    spread = 4 * spark.sparkContext.defaultParallelism
    counted = blocks.repartition(spread).mapInArrow(count, "path string, length long, block long, odd long, stray boolean")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("odd").over(before) % 2, F.lit(0)).cast("boolean")
    whole = F.max("stray").over(Window.partitionBy("path"))
    plan = counted.select("path", "length", "block", inside.alias("inside"), whole.alias("whole")).where("not whole or block = 0")
    plan = stage(plan, "table-blocks")
    first = plan.where("block = 0").orderBy(F.split("path", "/")).select("path").first()
    if first is None:
        return spark.createDataFrame([], "row_id long")

    with opened(first["path"]) as f:
        info = f.size()
        header = next(_rows(_segment(f, info, 0, min(1 << 16, info), False), sep), [])
    names = safe_names([h.removeprefix("﻿") if i == 0 else h for i, h in enumerate(header)])
    fields = ["_file", "_block", "_at", *[f"c{i}" for i in range(len(names))]]

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            for name, length, block, begins_inside, one in zip(*(p.column(i).to_pylist() for i in range(5)), strict=True):
                start = block * block_bytes
                with opened(name) as f:
                    if one:
                        lines = csv.reader(io.TextIOWrapper(f, "utf-8", "replace", newline=""), delimiter=sep)
                    else:
                        lines = _rows(_segment(f, length, start, min(start + block_bytes, length), begins_inside), sep)
                    held = []
                    for n, row in enumerate(lines):
                        if (block == 0 and n == 0) or not row:
                            continue
                        held.append((name, block, n, *row[: len(names)], *[""] * (len(names) - len(row))))
                        if len(held) == BATCH_ROWS:
                            yield pa.RecordBatch.from_pydict(dict(zip(fields, zip(*held, strict=True), strict=True)))
                            held = []
                    if held:
                        yield pa.RecordBatch.from_pydict(dict(zip(fields, zip(*held, strict=True), strict=True)))

    ddl = "_file string, _block long, _at long" + "".join(f", c{i} string" for i in range(len(names)))
    rows = plan.repartition(spread).mapInArrow(read, ddl).withColumn("_file", F.split("_file", "/"))
    numbered = with_dense_number(sequence_table(rows, ["_file", "_block", "_at"], "table-rows"), "row_id", base=-1)
    return numbered.select("row_id", *[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
