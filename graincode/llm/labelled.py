"""Folds and bounded training samples shared by the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id is in fold -1 (never held out, never learned from)."""
    return F.coalesce(F.crc32(id_col.cast("string")) % folds, F.lit(-1)).cast("int")


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, rows: int, id_col: str = "doc_id") -> DataFrame:
    """Rows of docs with column y (0/1): those of at most ``rows`` labelled documents, the first by a hash of the id.

    Only labels outside fold ``held`` are read. Labels that contradict each other for one id count as 0.
    """
    own = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & (fold(F.col(id_col), folds) != held))
    own = own.groupBy(F.col(id_col).alias("_id")).agg(F.min(label).cast("int").alias("y")).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    return docs.join(F.broadcast(own), docs[id_col] == F.col("_id")).drop("_id")  # at most ``rows`` rows are broadcast
