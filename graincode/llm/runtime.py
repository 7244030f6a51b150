"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import re
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_ready(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; only in local mode, where none is named, one of our own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="graincode-ckpt-"))


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through the reliable, shared checkpoint folder."""
    checkpoint_ready(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if(df: DataFrame, rows: int) -> DataFrame:
    """df to be broadcast if it is counted to have at most so many rows; otherwise as it is. df must be cheap to count."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fresh(df: DataFrame, stem: str) -> str:
    """A name that is neither a column of df nor the start of one."""
    taken, name = [c.lower() for c in df.columns], f"_{stem}"
    while any(c.startswith(name) for c in taken):
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of a batch of texts for Python, where the session has not set a number of its own.
TEXT_ROWS = 1000
_BATCH, _DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def text_batches(spark: SparkSession) -> None:
    """Let the session hand texts to Python by TEXT_ROWS rows, if it still has Spark's default, with which a batch of texts holds tens of MB twice.

    What an operator returns runs later, so the setting stays; one that the user made is left alone.
    """
    if spark.conf.get(_BATCH) == _DEFAULT:
        spark.conf.set(_BATCH, str(TEXT_ROWS))


def release_memory() -> None:
    """Give freed memory back to the system; a process otherwise holds on to what its largest batch took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def releasing(run: Callable) -> Callable:
    """A function of batches that releases memory when its task ends: Python workers outlive tasks and stages."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()

    return whole


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Smaller Arrow batches for what is run (not only planned) inside; the session's own setting holds again after."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)
