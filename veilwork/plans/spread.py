"""Use all cores on inputs with few splits, and on texts whose rows are few bytes but much work."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """Repartition a plain file scan only if it has fewer splits than there are cores.

    Such an input is small or not splittable, so moving it is cheap next to the pattern work. A large
    input has more splits than cores and is read in place, without a shuffle of the texts.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


#: Texts of a task: some seconds of detection.
ROWS_PER_TASK = 20_000


def deal(texts: DataFrame, key: str, rows: int) -> DataFrame:
    """Deal ``texts`` to tasks of at most about ``ROWS_PER_TASK`` rows, and to all cores at least.

    For texts made from narrow tables: the files and shuffles behind them are cut by their bytes, which are few next
    to the work on the texts, so some cores would get all of it. ``key`` is (nearly) different in every row.
    """
    cores = texts.sparkSession.sparkContext.defaultParallelism
    return texts.repartition(max(cores, -(-rows // ROWS_PER_TASK)), key)
