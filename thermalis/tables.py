"""Tables of a data folder, and tables written to cut a lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a folder of this machine, which only a local session may use."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="thermalis-")


def shared_path(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_folder(spark))
    return f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The same rows, read back from Parquet in the folder that driver and executors share."""
    spark, path = df.sparkSession, shared_path(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
