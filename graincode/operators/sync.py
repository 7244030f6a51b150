"""Synchronising two stores by id, content hash and time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plan(local: DataFrame, shared: DataFrame) -> DataFrame:
    """id, branch (of the local side), conflict and action (push, pull or none): the newer text time wins, ties and blanks push."""
    s = shared.select("id", F.col("content_hash").alias("s_hash"), F.col("indexed_at").alias("s_at"), F.lit(True).alias("s"))
    both = local.select("id", "branch", F.col("content_hash").alias("l_hash"), F.col("indexed_at").alias("l_at"), F.lit(True).alias("l")).join(s, "id", "full_outer")
    differs = F.col("l").isNotNull() & F.col("s").isNotNull() & ~F.col("l_hash").eqNullSafe(F.col("s_hash"))
    newer = F.coalesce("s_at", F.lit("")) > F.coalesce("l_at", F.lit(""))
    action = F.when(F.col("s").isNull(), "push").when(F.col("l").isNull(), "pull").when(differs & newer, "pull").when(differs, "push").otherwise("none")
    return both.select("id", "branch", differs.alias("conflict"), action.alias("action"))


def summary(planned: DataFrame) -> DataFrame:
    return planned.agg(F.count_if(F.col("action") == "push").alias("pushed"), F.count_if(F.col("action") == "pull").alias("pulled"), F.count_if("conflict").alias("conflicts"))


def branch_counts(rows: DataFrame, repo: str | None = None, branch: str | None = None) -> DataFrame:
    """Points of each branch that a push or pull moves."""
    return _scope(rows, repo, branch).groupBy("branch").agg(F.count(F.lit(1)).alias("points"))


def apply(local: DataFrame, shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both stores after the plan; nothing is ever deleted."""
    p = plan(local, shared).select("id", "action")
    push = local.join(p.where("action = 'push'"), "id", "left_semi")
    pull = shared.join(p.where("action = 'pull'"), "id", "left_semi")
    return local.join(pull, "id", "left_anti").unionByName(pull), shared.join(push, "id", "left_anti").unionByName(push)


def _scope(rows: DataFrame, repo: str | None, branch: str | None) -> DataFrame:
    own = rows if repo is None else rows.where(F.col("repo") == repo)
    return own if branch is None else own.where(F.col("branch") == branch)


def push(local: DataFrame, shared: DataFrame, repo: str | None = None, branch: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The shared store after all local points of a repo (and branch) are written to it, and the points of each branch that moved."""
    moved = _scope(local, repo, branch)
    return shared.join(moved.select("id"), "id", "left_anti").unionByName(moved), branch_counts(moved)


def pull(local: DataFrame, shared: DataFrame, repo: str | None = None, branch: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The local store after all shared points of a repo (and branch) are written to it, and the points of each branch that moved."""
    return push(shared, local, repo, branch)
