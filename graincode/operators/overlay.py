"""Branch overlays: which branch's row of a file is seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def in_lineage(rows: DataFrame, lineage: list[str]) -> DataFrame:
    return rows.where(F.col("branch").isin(lineage))


def overlay(rows: DataFrame, lineage: list[str], key: str = "file", position: str = "pos") -> DataFrame:
    """One row for each key: of the branch that comes first in lineage (others last), then the earliest."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(b) for b in lineage]), F.col("branch")), F.lit(0))
    rank = F.when(rank == 0, len(lineage) + 1).otherwise(rank)
    own = rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(rank, position)))
    return own.where("_r = 1").drop("_r")


def visible(rows: DataFrame, lineage: list[str], strict: bool = False, key: str = "file", position: str = "pos") -> DataFrame:
    """Rows that are no deletions; strict resolves the overlay first, so that a deletion hides lower branches."""
    return (overlay(rows, lineage, key, position) if strict else rows).where(~F.col("is_deletion"))
