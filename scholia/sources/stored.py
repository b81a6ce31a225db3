"""Cutting a plan by writing it to the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share. Where it is unset, a folder of this machine in local mode (tests);
    elsewhere that is an error, as other machines couldn't read it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="scholia-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """`df` computed once, written as Parquet and re-read: later uses read only the columns that they need, and Spark knows
    its size, so that it broadcasts it just where it is small."""
    spark = df.sparkSession
    df.write.parquet(path := f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}")
    return spark.read.schema(df.schema).parquet(path)
