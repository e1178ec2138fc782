"""State tables of a case on disk: all tables of a run become visible together.

A run writes its tables into a folder of its own. Then one small file with the next number, which names that folder,
is moved into place: until then the state is that of the run before. Two runs that started from the same state want
the same number, and the second one fails.
"""

from __future__ import annotations

import json
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from ..operators.registry import empty_case
from .files import open_store, store_uri

_MARK = "state-"


def _numbers(store: fs.FileSystem, base: str) -> list[int]:
    found = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
    return sorted(int(x.base_name.removeprefix(_MARK)) for x in found if x.base_name.startswith(_MARK))


def load_state(spark: SparkSession, folder: str) -> tuple[int, dict[str, DataFrame]]:
    """Number of the last finished run (0: none) and its tables; a new case has empty ones."""
    uri = store_uri(spark, folder)
    store, base = open_store(uri)
    empty = empty_case(spark)
    numbers = _numbers(store, base)
    if not numbers:
        return 0, empty
    with store.open_input_stream(f"{base}/{_MARK}{numbers[-1]}") as f:
        run = json.loads(f.read())["run"]
    return numbers[-1], {name: spark.read.schema(t.schema).parquet(f"{uri}/{run}/{name}") for name, t in empty.items()}


def commit_state(spark: SparkSession, folder: str, state: dict[str, DataFrame], after: int) -> int:
    """Write the tables as the run that follows number ``after``, and make them the state."""
    uri = store_uri(spark, folder)
    store, base = open_store(uri)
    run = f"run-{after + 1}-{uuid.uuid4().hex}"
    for name, rows in state.items():
        rows.write.parquet(f"{uri}/{run}/{name}")
    with store.open_output_stream(f"{base}/{run}/mark") as f:
        f.write(json.dumps({"run": run}).encode())
    final = f"{base}/{_MARK}{after + 1}"
    if store.get_file_info(final).type != fs.FileType.NotFound:
        raise RuntimeError(f"another run has changed the state of {folder} since it was read")
    store.move(f"{base}/{run}/mark", final)
    return after + 1
