"""Pipeline over the documents table: each stage works on all that the one before it kept.

Stages take ``(spark, docs, sf_dir)`` and return a DataFrame that is written and read again as the next one's
documents. All but the last return the columns of documents; the last returns the documents of the mix with
``size``, ``source_size``, ``target``, ``taken`` (words the mix takes) and ``copies`` beside them. Documents of
which the mix takes nothing are left out.

Repeated rows: the exact stage leaves one of them; equal rows given to the mix alone come back as one row with the
copies of all. Rows with equal or null ids and different texts are documents of their own. Null texts: language ID
rejects them. An empty table stays empty through all stages. Other columns pass through; columns named like those
of the mix are replaced by them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.llm import exact, langid, mixing, queries, simhash, tiling
from veilwork.plans.staging import run_folder, stage


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language isn't known well enough."""
    return langid.drop_rejected(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keep the document with the largest id."""
    index = exact.new_index(spark)
    kept = exact.drop_copies(docs, index)
    index.forget()
    return kept


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, keep the document with the smallest id."""
    return simhash.drop_near_copies(docs, queries.SHINGLE_WORDS, queries.LINK_BITS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that cover a benchmark item."""
    return tiling.drop_contaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the source mix, with the number of copies of each."""
    key = ["id", "tag", "skey"]
    taken = mixing.mix(docs, queries.MIX_WEIGHTS, queries.MIX_SHARE, queries.MIX_MOST, with_key=True)
    taken = taken.groupBy(*key, "size", "source_size", "target").agg(F.sum("taken").alias("taken"), F.count("*").alias("__rows"))
    taken = stage(taken.where("taken > 0").withColumnsRenamed({c: f"__{c}" for c in key}), "llm-mix-taken")
    own = docs.drop("size", "source_size", "target", "taken", "copies")
    if taken.where("__rows > 1").limit(1).count():
        own = own.dropDuplicates(["doc_id", "text", "source"])
    same = (
        own["doc_id"].cast("long").eqNullSafe(taken["__id"])
        & (F.xxhash64(own["text"].cast("string")) == taken["__tag"])
        & (mixing.source_key(own["source"]) == taken["__skey"])
    )
    taken = taken.withColumn("copies", (F.col("taken") / F.col("size")).cast("long"))
    return own.join(taken, same).drop("__id", "__tag", "__skey", "__rows")


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("benchmark_decontamination", decontaminated),
    ("source_mix", mixed),
]

#: Trained models and tilings can't be written as SQL; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        path = f"{run_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
