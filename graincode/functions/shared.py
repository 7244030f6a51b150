"""Cutting the lineage of iterative plans through the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names; only in local mode, where none is named, one of our own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="graincode-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df from the reliable checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """df as Parquet in the shared folder: written once, compressed, and read by columns, where a checkpoint keeps whole rows as they are."""
    spark, at = df.sparkSession, f"{checkpoint_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def spread(df: DataFrame, *keys: str, rows: int = 5_000) -> DataFrame:
    """df dealt by its keys to tasks of about so many rows, for rows of few bytes that take much work: files are split by bytes alone, and a
    small one would be one task. df must be cheap to count; it is shuffled, so what is made of a row comes after this."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(tasks, *keys)


def shuffled(df: DataFrame) -> DataFrame:
    """df, the other side of a join whose keys grow with the input, to be joined by sort and merge: adaptive plans judge a side by its compressed
    bytes, and rows that are much alike are broadcast through the driver at many times that size."""
    return df.hint("merge")


def broadcast_if(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """df to be broadcast if it is counted to have at most so many rows; otherwise as it is. df must be cheap to count."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
