"""Tables of queries and checks, and the data they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.spread import deal, spread
from .views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CASE = "case-1"

#: Views of a text for each order, joined from narrow columns.
FROM_ORDERS = ("ev_log",)


def query(name: str, oracle: str | None = None):
    """Register a query; ``oracle`` is the same result in SQL on the plain tables."""

    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as a corpus."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.col("doc_id").alias("ord"), "text")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An evidence view over the tables."""
    for base in ("customer", "orders", "nation", "supplier", "benchmark", "documents"):
        spread(table(spark, sf_dir, base)).createOrReplaceTempView(base)
    return spark.sql(with_views(f"select * from {name}"))


def corpus(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An evidence view with ``doc_id, ord, text``."""
    texts = view(spark, sf_dir, name).select("doc_id", F.col("doc_id").alias("ord"), "text")
    if name not in FROM_ORDERS:
        return texts
    return deal(texts, "doc_id", table(spark, sf_dir, "orders").count())


def span_output(spans: DataFrame) -> DataFrame:
    return spans.selectExpr(
        "doc_id", "cast(start as bigint) as span_start", "cast(end as bigint) as span_end", "raw_value", "pii_type",
        "confidence",
    )


def first_empty(spark: SparkSession) -> DataFrame:
    from ..operators.registry import empty_case

    return empty_case(spark)["registry"]
