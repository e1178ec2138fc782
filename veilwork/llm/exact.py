"""Exact dedup against a persistent digest index.

The index is a table of SHA-256 digests, bucketed and sorted by digest. A batch of documents is reduced to
one row per digest before anything is shuffled, meets the index in a sort-merge anti-join (the index side is
read bucket by bucket, without a shuffle), and its new digests are appended. Of equal texts in a batch the
row with the largest id stays, unless the index knows the text already. Only digests and ids are moved,
never texts; a text in a third of all rows is one row per task before the shuffle.

Every digest carries the batch that brought it. A batch that is run again under its name, after a crash at any point,
meets only the digests of other batches and adds only those of its own that are missing: the same rows stay.

Defined cases: null text is empty, long texts are hashed whole. Null ids are smaller than all others; if all ids of a
group are null, the null rows are kept. Every row comes back, also rows with equal id and text; ``drop_copies`` leaves
one of them. An empty table gives an empty result. Other columns are ignored by ``exact_groups`` and pass through
``drop_copies`` unchanged, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import run_folder, stage
from .common import without


class DigestIndex:
    """Bucketed table ``digest binary, keep_id long, batch string``; opened again by the same name or path."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, name: str | None = None):
        self.spark, self.buckets = spark, buckets
        self.name = name or f"llm_digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"create table if not exists {self.name} (digest binary, keep_id bigint, batch string) using parquet "
            f"clustered by (digest) sorted by (digest) into {buckets} buckets location '{path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def others(self, batch: str) -> DataFrame:
        """``digest, known_id`` of all other batches (a text is held once)."""
        return self.rows().where(F.col("batch") != batch).select("digest", F.col("keep_id").alias("known_id"))

    def append(self, fresh: DataFrame, batch: str) -> None:
        """Add the digests of a batch that aren't there yet."""
        held = self.rows().where(F.col("batch") == batch).select("digest")
        missing = fresh.select("digest", "keep_id").join(held.hint("merge"), "digest", "left_anti")
        (
            missing.withColumn("batch", F.lit(batch))
            .repartition(self.buckets, "digest")
            .write.bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .mode("append")
            .format("parquet")
            .saveAsTable(self.name)
        )

    def forget(self) -> None:
        """Take the table out of the catalog; its files stay until the folder is cleared."""
        self.spark.sql(f"drop table if exists {self.name}")


def new_index(spark: SparkSession, buckets: int = 64) -> DigestIndex:
    """An empty index among the staged tables of the session."""
    return DigestIndex(spark, f"{run_folder(spark)}/llm-digests-{uuid.uuid4().hex}", buckets)


def _digest(docs: DataFrame, text_col: str):
    return F.unhex(F.sha2(F.coalesce(docs[text_col].cast("string"), F.lit("")), 256))


def exact_groups(
    docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None
) -> DataFrame:
    """``id, keep_id, group_size, known, kept, digest`` for each row; new digests go into the index.

    ``known``: another batch brought the text before; then ``keep_id`` is the id stored with it, and no row of this batch
    is kept. ``batch`` names the batch; give the same name to a rerun. Without a name it is a batch of its own.
    """
    batch = batch or uuid.uuid4().hex
    text = docs[text_col].cast("string")
    hashed = docs.select(docs[id_col].cast("long").alias("id"), _digest(docs, text_col).alias("digest"), F.xxhash64(text).alias("tag"))
    groups = hashed.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    known = index.others(batch).hint("merge")
    groups = stage(groups.join(known.withColumn("known", F.lit(True)), "digest", "left"), "llm-digest-groups")
    index.append(groups.where("known is null"), batch)
    marked = groups.select(
        "digest", F.when(F.col("known").isNull(), F.col("keep_id")).otherwise(F.col("known_id")).alias("keep_id"), "group_size",
        F.col("known").isNotNull().alias("known"),
    )
    kept = ~F.col("known") & F.col("id").eqNullSafe(F.col("keep_id"))
    return hashed.join(marked, "digest").select("id", "keep_id", "group_size", "known", kept.alias("kept"), "digest", "tag")


def drop_copies(
    docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None
) -> DataFrame:
    """The documents that stay, with all their columns; texts stay in place, only those that may go are joined."""
    groups = stage(exact_groups(docs, index, id_col, text_col, batch), "llm-exact")
    key = F.xxhash64("id", "tag").alias("__key")
    gone = stage(groups.where("not kept").select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), key).distinct(), "llm-exact-gone")
    id_, text = docs[id_col].cast("long"), docs[text_col].cast("string")
    same = id_.eqNullSafe(gone["__id"]) & (_digest(docs, text_col) == gone["__digest"])
    out = without(docs, F.xxhash64(id_, F.xxhash64(text)), gone, same)
    if groups.where("kept").groupBy("id", "digest").count().where("count > 1").limit(1).count():
        out = out.dropDuplicates([id_col, text_col])
    return out
