"""Tables looked up by key that grow batch by batch, of which a batch reads only what its keys can hit.

Every batch writes its rows as one generation, split by the hash of their key into so many folders that each holds
about ``BUCKET_ROWS`` rows. A small file per batch names the live generations; it is written last, so a batch that
failed or is run again starts from the file of the batch before. When ``MOST_GENERATIONS`` are live they are merged
into one with as many folders as its size asks for, so that a look-up of few keys stays as cheap as it was.
"""

from __future__ import annotations

import json

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import stage
from ..sources.files import open_store, store_uri

BUCKET_ROWS, MOST_GENERATIONS = 4096, 8
#: Folders of a generation that are read one by one; a batch that hits more reads the generation as a whole.
MOST_PATHS = 512


class BatchState:
    """Numbered small files under a folder: what the state is after each batch."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.uri = spark, store_uri(spark, folder)
        self.store, self.base = open_store(self.uri)

    def before(self, batch: int) -> dict:
        """The state after the last batch before ``batch``; empty if there is none."""
        found = self.store.get_file_info(fs.FileSelector(self.base, allow_not_found=True))
        known = [int(x.base_name[6:]) for x in found if x.base_name.startswith("after-") and int(x.base_name[6:]) < batch]
        if not known:
            return {}
        with self.store.open_input_stream(f"{self.base}/after-{max(known)}") as f:
            return json.loads(f.read())

    def commit(self, batch: int, state: dict) -> None:
        final = f"{self.base}/after-{batch}"
        self.store.create_dir(self.base, recursive=True)
        with self.store.open_output_stream(f"{final}.part") as f:
            f.write(json.dumps(state).encode())
        if self.store.get_file_info(final).type != fs.FileType.NotFound:
            self.store.delete_file(final)
        self.store.move(f"{final}.part", final)

    def drop(self, names: list[str]) -> None:
        for name in names:
            if self.store.get_file_info(f"{self.base}/{name}").type == fs.FileType.Directory:
                self.store.delete_dir(f"{self.base}/{name}")


class KeyTable:
    """One table ``h long, …`` of a ``BatchState``; ``live`` are its generations ``{name, buckets, rows}``."""

    def __init__(self, state: BatchState, name: str, schema: str, live: list[dict], bucket_rows: int = BUCKET_ROWS):
        self.state, self.name, self.live, self.bucket_rows = state, name, list(live), bucket_rows
        self.schema = f"h bigint, {schema}"

    def _folder(self, generation: dict) -> str:
        return f"{self.state.uri}/{generation['name']}"

    def paths(self, keys: DataFrame) -> list[str]:
        """Folders that may hold rows for ``keys(h)``."""
        out = []
        for g in self.live:
            bucket = F.pmod(F.col("h"), F.lit(g["buckets"])).alias("b")
            hit = [r["b"] for r in keys.select(bucket).distinct().limit(MOST_PATHS + 1).collect()]
            if len(hit) > MOST_PATHS:
                out.append(self._folder(g))
                continue
            own = [f"{g['name']}/bucket={b}" for b in hit]
            there = self.state.store.get_file_info([f"{self.state.base}/{p}" for p in own])
            out += [f"{self.state.uri}/{p}" for p, x in zip(own, there, strict=True) if x.type == fs.FileType.Directory]
        return out

    def find(self, keys: DataFrame) -> DataFrame:
        """Rows whose key is one of ``keys(h)`` (a staged table)."""
        spark, paths = self.state.spark, self.paths(keys)
        if not paths:
            return spark.createDataFrame([], self.schema)
        rows = spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(*paths)
        return rows.join(keys.select("h").distinct(), "h", "left_semi")

    def add(self, rows: DataFrame, batch: int) -> list[dict]:
        """Write the rows of a batch; gives the generations that are live from now on."""
        rows = stage(rows, f"state-{self.name}")
        live = [*self.live, self._written(rows, f"{self.name}-{batch}")]
        live = [g for g in live if g["rows"]]
        if len(live) <= MOST_GENERATIONS:
            return live
        whole = self.state.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(*[self._folder(g) for g in live])
        return [self._written(whole, f"{self.name}-upto-{batch}")]

    def _written(self, rows: DataFrame, name: str) -> dict:
        n = rows.count()
        buckets = 1 << max(0, (n // self.bucket_rows).bit_length())
        bucket = F.pmod(F.col("h"), F.lit(buckets)).alias("bucket")
        parts = rows.select("*", bucket).repartition(min(buckets, 4 * self.state.spark.sparkContext.defaultParallelism), "bucket")
        parts.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.state.uri}/{name}")
        return {"name": name, "buckets": buckets, "rows": n}


def hashed(kind: str, case_id: str, key: str) -> Column:
    """64-bit key of an SQL expression within a case."""
    return F.xxhash64(F.lit(kind), F.lit(case_id), F.expr(key))
