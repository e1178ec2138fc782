"""Written intermediate tables.

A staged table cuts the lineage, survives the loss of executors and gives the planner a true size, so
that a small side is broadcast by Spark's own size check and a large one is shuffled. The shuffle files behind it are
removed as soon as it is written; nothing reads them again.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage_root(spark: SparkSession) -> str:
    """Shared folder for staged tables: ``spark.checkpoint.dir`` of the session."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not re.fullmatch(r"local(\[[^]-]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    # one machine: driver and tasks are one process, so any folder is shared
    root = tempfile.mkdtemp(prefix="veilwork-stage-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def run_folder(spark: SparkSession) -> str:
    """Folder of the staged tables of this application."""
    return f"{stage_root(spark)}/veilwork/{spark.sparkContext.applicationId}"


def clear_stages(spark: SparkSession) -> None:
    """Delete the staged tables of this application; results that still read them must be written before."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back."""
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_REMOVE_SHUFFLES, "false")
    spark.conf.set(_REMOVE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_REMOVE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)
