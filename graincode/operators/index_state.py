"""Index records, branch lineage and session history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graincode.functions.scalars import repo_name, trim_slashes
from graincode.functions.shared import cut
from graincode.operators.graph import references
from graincode.operators.vector import read_symbol, where_metadata


def last_records(state: DataFrame) -> DataFrame:
    """The newest record of each (repo_path, branch); later record ids win ties."""
    rest = [c for c in state.columns if c not in ("repo_path", "branch")]
    newest = state.groupBy("repo_path", "branch").agg(F.max_by(F.struct(*rest), F.struct("indexed_at", "record")).alias("_r"))
    return newest.select("repo_path", "branch", *[f"_r.{c}" for c in rest])


def normalize_paths(state: DataFrame) -> DataFrame:
    """Paths without slashes at the end; a slashed row leaves where a clean one of the same branch exists."""
    clean = state.where(~F.col("repo_path").endswith("/")).select("repo_path", "branch").distinct()
    slashed = state.where(F.col("repo_path").endswith("/")).withColumn("repo_path", trim_slashes(F.col("repo_path"))).join(clean, ["repo_path", "branch"], "left_anti")
    return state.where(~F.col("repo_path").endswith("/")).unionByName(slashed)


def status(state: DataFrame, repo: str | None = None, branch: str | None = None) -> DataFrame:
    """One row for each repo (by name) and branch."""
    own = last_records(state).withColumn("repo", repo_name(F.col("repo_path")))
    own = own if repo is None else own.where(F.col("repo") == repo)
    own = own if branch is None else own.where(F.col("branch") == branch)
    return own.select("repo", "branch", "last_commit", "symbol_count", "indexed_at", F.lit("indexed").alias("status"))


def changed_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files without a record, or whose hash differs from it; files with the same hash are left out."""
    own = files.join(known.select("repo", "branch", "file", F.col("content_hash").alias("known_hash")), ["repo", "branch", "file"], "left")
    return own.where(~F.col("content_hash").eqNullSafe(F.col("known_hash")))


def lineage(base: DataFrame, start: str | None = None) -> DataFrame:
    """branch, ancestor, depth: chains from each branch (or one) to its root, however long; a cycle ends a chain.

    base (branch, base_branch) has a row for each branch of a repository and is small beside the data. Each round doubles the
    length that is known of all chains, until nothing new comes.
    """
    base = cut(base.select("branch", "base_branch").distinct())
    jump = base.where("branch IS NOT NULL AND base_branch IS NOT NULL").select("branch", F.col("base_branch").alias("to"))
    own = base.select("branch").distinct()
    known = own.union(jump.select("to")).distinct().select("branch", F.col("branch").alias("ancestor"), F.lit(0).alias("depth"))
    length, count = 1, known.count()
    while True:
        far = jump.join(known.withColumnRenamed("branch", "to"), "to").select("branch", "ancestor", (F.col("depth") + length).alias("depth"))
        known = cut(known.union(far).groupBy("branch", "ancestor").agg(F.min("depth").alias("depth")))
        before, count = count, known.count()
        if count == before:
            break
        jump = cut(jump.join(jump.select(F.col("branch").alias("to"), F.col("to").alias("_to")), "to").select("branch", F.col("_to").alias("to")).distinct())
        length *= 2
    own = own if start is None else own.where(F.col("branch") == start)
    return known.join(own, "branch", "left_semi")


def history(state: DataFrame, limit: int = 50) -> DataFrame:
    """An index event for each (repo, branch), newest first."""
    text = F.concat(F.lit("Indexed "), F.col("symbol_count").cast("string"), F.lit(" symbols at "), F.substring("last_commit", 1, 8))
    own = status(state).select(F.lit("index").alias("type"), "repo", "branch", F.col("indexed_at").alias("timestamp"), text.alias("summary"))
    return own.orderBy(F.desc("timestamp"), "repo", "branch").limit(limit)


def close_active(sessions: DataFrame, keys: list[str]) -> DataFrame:
    """sessions (keys, session, started) with ended: starting one closes the one before."""
    return sessions.withColumn("ended", F.lead("started").over(Window.partitionBy(*keys).orderBy("started", "session")))


def recent_sessions(sessions: DataFrame, limit: int = 20) -> DataFrame:
    return sessions.orderBy(F.desc("started"), F.desc("session")).limit(limit)


def recent_events(events: DataFrame, limit: int = 50) -> DataFrame:
    """Newest events, with defaults for what is missing; metadata is JSON text."""
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(limit).select("event_id", F.coalesce("event_type", F.lit("")).alias("event_type"), F.coalesce("props", F.lit("{}")).alias("metadata"), F.get_json_object("props", "$.k").alias("k"))


class ActiveContext:
    """The repo and branch that a session works in: defaults, for what is not given, of index status, symbol look-up and references.

    Searches and context assembly do not use it.
    """

    def __init__(self, repo: str | None = None, branch: str | None = None):
        self.repo, self.branch = repo, branch

    def switch(self, repo: str | None = None, branch: str | None = None) -> "ActiveContext":
        """What is given replaces what was; the rest stays."""
        self.repo, self.branch = repo or self.repo, branch or self.branch
        return self

    def status(self, state: DataFrame, repo: str | None = None, branch: str | None = None) -> DataFrame:
        return status(state, repo or self.repo, branch or self.branch)

    def read_symbol(self, points: DataFrame, query: DataFrame, name: str, repo: str | None = None, branch: str | None = None) -> DataFrame:
        return read_symbol(where_metadata(points, repo=repo or self.repo, branch=branch or self.branch), query, name)

    def references(self, edges: DataFrame, points: DataFrame, query: DataFrame, symbol: str, repo: str | None = None, branch: str | None = None, order: str = "ord") -> DataFrame:
        return references(edges, points, query, symbol, repo or self.repo or "", branch or self.branch, order)


def put_records(records: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("repo", "branch", "file")) -> DataFrame:
    """File records after new ones replace those of their keys."""
    return records.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def remove_records(records: DataFrame, gone: DataFrame, keys: tuple[str, ...] = ("repo", "branch", "file")) -> DataFrame:
    return records.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def start_session(sessions: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """sessions (keys, session, started, ended) after new ones start: an open one of the same keys ends when the new one starts."""
    own = sessions.join(new.select(*keys, F.col("started").alias("_now")), keys, "left")
    return own.withColumn("ended", F.coalesce("ended", "_now")).drop("_now").unionByName(new)


def end_session(sessions: DataFrame, session: str, at) -> DataFrame:
    """An open session ends; one that has ended keeps its end."""
    return sessions.withColumn("ended", F.when((F.col("session") == session) & F.col("ended").isNull(), F.lit(at)).otherwise(F.col("ended")))
