"""Pieces that several operators share: row keys, bounded bit filters, Arrow helpers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.keyfilter import key_filter
from ..plans.staging import stage

#: Words of the contracts: runs of anything but space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

#: Largest bit filter that is sent to executors: 2**28 bits, 32 MiB. Larger key sets are joined instead.
MAX_FILTER_BITS = 1 << 28
_BITS_PER_KEY = 16


def utf8(column: pa.Array) -> list[bytes]:
    """Bytes of a string column; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(key long, id, text string, copies long)`` with one row per distinct (id, text), in the order of the ids.

    Where ids are unique and not null, the key is the id and nothing is moved. Else rows with equal id and
    text are one document of several ``copies``, null ids come first, equal ids are ordered by the hash of their
    text, and the keys are dense numbers in that order.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    repeated = rows.groupBy("id").count().where("count > 1 or id is null").limit(1).count()
    if not repeated:
        return rows.select(F.col("id").alias("key"), "id", "text", F.lit(1).cast("long").alias("copies"))
    from ..plans.numbering import sequence_table, with_dense_number

    tagged = rows.withColumn("tag", F.sha2(F.coalesce("text", F.lit("")), 256))
    order = tagged.select(F.coalesce("id", F.lit(-(1 << 63))).alias("at"), "id", "tag").distinct()
    numbers = with_dense_number(sequence_table(order, ["at", "id", "tag"], "llm-keys"), "key").select("key", "id", "tag")
    numbers = stage(numbers.select("key", F.col("id").alias("nid"), F.col("tag").alias("ntag")), "llm-keys")
    once = tagged.groupBy("id", "tag").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    dense = once.join(numbers, F.col("id").eqNullSafe(F.col("nid")) & (F.col("tag") == F.col("ntag")))
    # staged: each scan of the rows would shuffle all texts anew
    return stage(dense.select("key", "id", "text", "copies"), "llm-keyed")


class BitFilter:
    """Two hashed bits per 64-bit key in a bitmap of bounded size: no key is missed, a few others pass."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.mask = np.uint64(len(bits) * 64 - 1)

    def passes(self, keys: np.ndarray) -> np.ndarray:
        return self._bit(keys & self.mask) & self._bit((keys >> np.uint64(32)) & self.mask)

    def _bit(self, place: np.ndarray) -> np.ndarray:
        return ((self.bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1)).astype(bool)


def bit_filter(keys: DataFrame, column: str, max_bits: int = MAX_FILTER_BITS) -> BitFilter | None:
    """Filter of a long column, built by Spark; None if the keys are too many for the size bound.

    The bitmap that reaches the driver has at most ``max_bits`` bits whatever the input.
    """
    n = keys.count()
    size = max(1 << 10, 1 << (n * _BITS_PER_KEY - 1).bit_length() if n else 0)
    if size > max_bits:
        return None
    both = keys.select(
        F.explode(
            F.array(
                F.col(column).bitwiseAND(size - 1),
                F.shiftrightunsigned(F.col(column), 32).bitwiseAND(size - 1),
            )
        ).alias("place")
    )
    words = (
        both.groupBy(F.shiftright("place", 6).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))").alias("bits"))
        .toArrow()
    )
    bits = np.zeros(size // 64, np.uint64)
    for part in words.to_batches():
        place, own = (part.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
        bits[place] = own.view(np.uint64)
    return BitFilter(bits)


def shared(spark: SparkSession, value):
    """A broadcast variable of a value whose size is bounded by the caller."""
    return spark.sparkContext.broadcast(value)


def without(docs: DataFrame, key: Column, gone: DataFrame, same: Column) -> DataFrame:
    """``docs`` without the rows that ``same`` finds in ``gone``, a staged table with their 64-bit keys as ``__key``.

    ``key`` is the key of a document. Documents whose key the bit filter of ``gone`` doesn't know stay where they are;
    only the others, those that go and a few more, meet the table in a join.
    """
    known = key_filter(gone, "__key", least=1)
    if known.bits is None:  # nothing goes, or too many for a filter
        return docs.join(gone, same, "left_anti")
    asked = docs.where(known.passes(key)).join(gone, same, "left_anti")
    return docs.where(~known.passes(key)).unionByName(asked)
