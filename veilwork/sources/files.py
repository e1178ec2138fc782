"""Files of any name: listed and read in Spark tasks, and written back under their own paths.

Spark's own file readers pass over empty files and names that start with ``_`` or ``.``. Here folders are listed by
tasks, level by level, and files are opened by path, so such files are files like others. Tasks reach the store
through ``pyarrow.fs`` (local disks, HDFS and what its libraries open, object stores); the driver loops over the
levels of the tree only and holds neither names nor contents.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import stage

#: Bytes of an output batch, and of the files that one reading task is given (about).
BATCH_BYTES, TASK_BYTES = 16 << 20, 64 << 20
#: A file is one row; this is what a row can hold.
MOST_BYTES = (1 << 31) - 1

_LISTED = pa.schema([("path", pa.string()), ("length", pa.int64()), ("folder", pa.bool_())])
_WRITTEN = pa.schema([("path", pa.string()), ("length", pa.int64()), ("file_hash", pa.string())])


def store_uri(spark: SparkSession, path: str) -> str:
    """The path with scheme and authority of its file system, without a slash at the end."""
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toString()
    return whole.rstrip("/")


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and plain path of a URI; the path is taken as it stands, nothing in it is decoded."""
    scheme, authority, path = re.fullmatch(r"([A-Za-z][A-Za-z0-9+.-]*):(//[^/]*)?(/.*)?", uri, re.DOTALL).groups()
    if scheme == "file":
        return fs.LocalFileSystem(), path or "/"
    store, root = fs.FileSystem.from_uri(f"{scheme}:{authority or '//'}/")
    return store, (root.rstrip("/") + (path or "")) or "/"


def _leftover(name: str) -> bool:
    """Marks and checksums that jobs leave behind."""
    return name == "_SUCCESS" or (name.startswith(".") and name.endswith(".crc"))


def _entries(store: fs.FileSystem, base: str) -> Iterator[tuple[str, int, bool]]:
    """``(name, length, is folder)`` of a folder; a local one is read as a stream, whatever its size."""
    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(base) as found:
            for x in found:
                is_folder = x.is_dir()
                if not (_leftover(x.name) or (is_folder and x.is_symlink())):
                    yield x.name, 0 if is_folder else _size(x), is_folder
        return
    for x in store.get_file_info(fs.FileSelector(base)):
        if not _leftover(x.base_name):
            yield x.base_name, x.size or 0, x.type == fs.FileType.Directory


def _size(entry: os.DirEntry) -> int:
    try:
        return entry.stat().st_size
    except FileNotFoundError:  # a link to nothing
        return 0


def list_tree(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """``files(path, length)`` under ``root``, path relative to it, whatever the names; linked folders aren't entered."""
    uri = store_uri(spark, root)

    def entries(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(uri)
        for p in parts:
            for folder in p.column(0).to_pylist():
                found = _entries(store, f"{base}/{folder}" if folder else base)
                while rows := [(f"{folder}/{n}" if folder else n, *rest) for n, *rest in islice(found, 1 << 14)]:
                    cols = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _LISTED, strict=True)], schema=_LISTED)

    level, files = spark.createDataFrame([("",)], "path string"), None
    cores = spark.sparkContext.defaultParallelism
    while True:
        found = stage(level.mapInArrow(entries, "path string, length long, folder boolean"), "listed")
        own = found.where("not folder").drop("folder")
        files = own if files is None else files.unionByName(own)
        level = found.where("folder").select("path")
        if not recursive or not level.limit(1).count():
            return files
        level = level.repartition(4 * cores)


def with_content(files: DataFrame, root: str) -> DataFrame:
    """``files(path, length, …)`` with ``content``, opened by path; large corpora are dealt to tasks by bytes."""
    spark = files.sparkSession
    uri = store_uri(spark, root)
    total = files.agg(F.sum("length").alias("n")).first()["n"] or 0
    dealt = files.repartition(max(spark.sparkContext.defaultParallelism, total // TASK_BYTES))
    at = files.columns.index("path")

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(uri)
        for p in parts:
            lo, size, held = 0, 0, []
            for i, path in enumerate(p.column(at).to_pylist()):
                with store.open_input_stream(f"{base}/{path}") as f:
                    content = f.read()
                if len(content) > MOST_BYTES:
                    raise ValueError(f"{path}: {len(content)} bytes are too many for a row")
                if held and size + len(content) > BATCH_BYTES:
                    yield _joined(p.slice(lo, len(held)), held)
                    lo, size, held = i, 0, []
                held.append(content)
                size += len(content)
            if held:
                yield _joined(p.slice(lo, len(held)), held)

    kinds = ", ".join(f"`{c}` {t}" for c, t in files.dtypes)
    return dealt.mapInArrow(read, f"{kinds}, content binary")


def _joined(rows: pa.RecordBatch, content: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*rows.columns, pa.array(content, pa.binary())], [*rows.schema.names, "content"])


def _put(store: fs.FileSystem, final: str, data: bytes, spare: str) -> None:
    """Write a file as a whole: under another name first, then moved. The same bytes may be there already."""

    def there() -> bool:
        info = store.get_file_info(final)
        if info.type == fs.FileType.NotFound:
            return False
        if info.type == fs.FileType.File and info.size == len(data):
            with store.open_input_stream(final) as f:
                if f.read() == data:
                    return True
        raise FileExistsError(f"{final} exists with other content")

    if there():
        return
    with store.open_output_stream(spare) as f:
        f.write(data)
    store.create_dir(final.rsplit("/", 1)[0], recursive=True)
    try:
        store.move(spare, final)
    except OSError:
        if not there():  # another attempt at the same task may have been first
            raise


def _one_by_one(rows: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """Paths and texts of a batch; a text leaves the batch when it is its turn."""
    for path, text in zip(rows.column(0).to_pylist(), rows.column(1).cast(pa.binary()), strict=True):
        yield path, text.as_py() or b""


def write_files(docs: DataFrame, out: str) -> DataFrame:
    """Write ``docs(path, text)`` as ``out/<path>``, byte for byte in UTF-8; gives ``(path, length, file_hash)`` (staged).

    A file appears whole or not at all. An existing file is never replaced: the same content counts as written, so a
    failed run can be repeated, other content is an error. Null text is an empty file.
    """
    spark = docs.sparkSession
    uri = store_uri(spark, out)
    spare = f"{uri}.writing-{uuid.uuid4().hex}"

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(uri)
        _, aside = open_store(spare)
        store.create_dir(aside, recursive=True)
        for p in parts:
            done = []
            for path, data in _one_by_one(p):
                if path.startswith("/") or ".." in path.split("/"):
                    raise ValueError(f"not a path under the output folder: {path}")
                _put(store, f"{base}/{path}", data, f"{aside}/{uuid.uuid4().hex}")
                done.append((path, len(data), hashlib.sha256(data).hexdigest()))
            if done:
                cols = zip(*done, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _WRITTEN, strict=True)], schema=_WRITTEN)

    rows = docs.select("path", F.col("text").cast("string").alias("text"))
    written = stage(rows.mapInArrow(write, "path string, length long, file_hash string"), "written")
    store, aside = open_store(spare)
    if store.get_file_info(aside).type == fs.FileType.Directory:
        store.delete_dir(aside)
    return written
