"""Indexing: from changes and contents to chunks, edges and records, as one plan."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graincode.functions.scalars import content_hash, deterministic_id, sha_prefix
from graincode.operators.chunking import chunk
from graincode.sources.changes import exclude as exclude_globs
from graincode.sources.changes import glob_to_regex
from graincode.operators.parsing import call_edges, import_edges, imports_of, parse, symbols_of
from graincode.functions.shared import kept, shuffled
from graincode.sources.store import VersionedTable


def needs_work(files: DataFrame, known: DataFrame, full: bool = False) -> DataFrame:
    """Files to be parsed: all if full, else those whose hash differs from their record's."""
    own = files.withColumn("content_hash", content_hash(F.col("content")))
    if full:
        return own
    old = known.select("file", F.col("content_hash").alias("_old"))
    return own.join(shuffled(old), "file", "left").where(~F.col("content_hash").eqNullSafe(F.col("_old"))).drop("_old")


def apply_changes(state: DataFrame, changes: DataFrame) -> DataFrame:
    """Records after deletions and renames (status, path, old_path); added and modified ones wait to be parsed."""
    gone = changes.where("status = 'deleted'").select(F.col("path").alias("file")).distinct()
    moved = changes.where("status = 'renamed'").select(F.col("old_path").alias("file"), F.col("path").alias("_to")).dropDuplicates(["file"])
    own = state.join(shuffled(gone), "file", "left_anti").join(shuffled(moved), "file", "left")
    return own.withColumn("file", F.coalesce("_to", "file")).drop("_to")


def index(files: DataFrame, split_raw: bool = False, keep: bool = True) -> dict[str, DataFrame]:
    """chunks, edges, records and errors of files (file, language, content).

    What is parsed is written once, and read by columns for each of them; with keep false each parses on its own, for a caller of one alone.
    """
    own = files.withColumn("content_hash", content_hash(F.col("content")))
    whole = kept(parse(own, more=("content_hash",))) if keep else None
    parsed = lambda *parts: parse(own, parts=parts, more=("content_hash",)) if whole is None else whole
    symbols, imports = symbols_of(parsed("symbols")), imports_of(parsed("imports"))
    edges = call_edges(parsed("calls")).unionByName(import_edges(imports))
    records = parsed("symbols").where("error IS NULL").select("file", "language", F.size("symbols").alias("symbol_count"), "content_hash")
    good, errors = parsed().where("error IS NULL").select("file", "language"), parsed().where("error IS NOT NULL").select("file", "error")
    return {"chunks": chunk(good, symbols, imports, split_raw), "edges": edges, "records": records, "errors": errors}


def summary(chunks: DataFrame, records: DataFrame) -> DataFrame:
    """file_count, symbol_count and chunk_count of a run."""
    n = records.agg(F.count(F.lit(1)).alias("file_count"), F.coalesce(F.sum("symbol_count"), F.lit(0)).alias("symbol_count"))
    return n.crossJoin(F.broadcast(chunks.agg(F.count(F.lit(1)).alias("chunk_count"))))


def run_mode(last: DataFrame, model: str, incremental: bool = True) -> str:
    """full for a first run, another model than the last record's, or if asked for; else incremental. last: one row with model, or none."""
    row = last.select("model").first()
    return "incremental" if incremental and row is not None and row["model"] == model else "full"


def selected(files: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, languages: list[str] | None = None, path: str = "file") -> DataFrame:
    """Files that match one of the include globs (if any), none of the exclude globs, and are of one of the languages (if any)."""
    if include:
        files = files.where(reduce(Column.__or__, [F.col(path).rlike(glob_to_regex(g)) for g in include]))
    if languages:
        files = files.where(F.col("language").isin(languages))
    return exclude_globs(files, exclude or [], path)


def index_repo(files: DataFrame, records: DataFrame, last: DataFrame, model: str, changes: DataFrame | None = None, incremental: bool = True, split_raw: bool = False, keep: bool = True) -> dict[str, DataFrame | str]:
    """One run over the files of a branch (file, language, content), as one plan.

    records (file, language, symbol_count, content_hash) is what the last run left, changes (path, status, old_path) what happened since. A full
    run parses every file whatever its hash, and files of records that are no longer there count as deleted. An incremental run
    routes the changes: deleted files leave, renamed ones move and are parsed again if their hash differs, added and modified ones are parsed
    if it does. A file that fails keeps its error and nothing else; the others go on.

    Returns mode, chunks, edges and errors of the run, removed (files whose points and edges go: deleted, vanished, or parsed again), moved
    (file, new_file), records after the run, and totals: one row with the counts of the run and of all records.
    """
    mode = run_mode(last, model, incremental and changes is not None)
    none = records.select("file").where(F.lit(False))
    if mode == "full":
        before, work = records, needs_work(files, records, full=True)
        moved = none.withColumn("new_file", F.col("file"))
        deleted = records.join(shuffled(files.select("file")), "file", "left_anti").select("file")
    else:
        before = apply_changes(records, changes)
        touched = changes.where("status IN ('added', 'modified', 'renamed')").select(F.col("path").alias("file")).distinct()
        work = needs_work(files.join(shuffled(touched), "file", "left_semi"), before)
        moved = changes.where("status = 'renamed'").select(F.col("old_path").alias("file"), F.col("path").alias("new_file")).distinct()
        deleted = changes.where("status = 'deleted'").select(F.col("path").alias("file"))
    done = index(work.select("file", "language", "content"), split_raw, keep)
    gone = deleted.union(work.select("file")).distinct()
    after = before.join(shuffled(gone), "file", "left_anti").unionByName(done["records"])
    run = summary(done["chunks"], done["records"])
    total = after.agg(F.count(F.lit(1)).alias("total_files"), F.coalesce(F.sum("symbol_count"), F.lit(0)).alias("total_symbols"))
    removed = deleted.join(shuffled(files.select("file")), "file", "left_anti").agg(F.count(F.lit(1)).alias("deleted_files"))
    totals = run.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(removed))  # three tables of one row
    return {"mode": mode, "chunks": done["chunks"], "edges": done["edges"], "errors": done["errors"], "removed": gone, "moved": moved, "records": after, "totals": totals}


#: Order of chunk levels: of chunks of a file that begin in one line, and so share an id, the last stays.
LEVELS = ("file", "class", "function", "block")


def points_of(chunks: DataFrame, repo: str, branch: str, embed: Callable[[DataFrame], DataFrame], commit: str = "") -> DataFrame:
    """Points of the chunks of a branch; embed gives id and vector of (id, text)."""
    level = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("level")), F.lit(0))
    ranked = chunks.withColumns({"repo": F.lit(repo), "branch": F.lit(branch), "commit": F.lit(commit), "_rank": level})
    ranked = ranked.withColumn("id", deterministic_id(F.col("repo"), F.col("branch"), F.col("file"), F.col("start_line")))
    names = [c for c in ranked.columns if c not in ("id", "_rank")]
    one = kept(ranked.groupBy("id").agg(F.max_by(F.struct(*names), F.struct("_rank", "end_line", "text")).alias("_p")).select("id", *[f"_p.{c}" for c in names]))
    made = one.join(shuffled(embed(one.select("id", "text"))), "id").withColumnRenamed("level", "chunk_level")
    return made.withColumns({"content_hash": content_hash(F.col("text")), "is_deletion": F.lit(False)})


def rename_edges(edges: DataFrame, moves: DataFrame) -> DataFrame:
    """Edges of files that have moved (repo, branch, file, new_file): their sources begin with the new path, their ids follow."""
    own = edges.join(shuffled(moves.select("repo", "branch", "file", "new_file")), ["repo", "branch", "file"], "left")
    inside = F.col("new_file").isNotNull() & F.startswith("source", F.concat("file", F.lit("::")))
    source = F.when(inside, F.concat("new_file", F.substring(F.col("source"), F.char_length("file") + 1, F.char_length("source")))).otherwise(F.col("source"))
    return edge_rows(own.withColumn("source", source).withColumn("file", F.coalesce("new_file", "file")).drop("new_file"))


def edge_rows(edges: DataFrame) -> DataFrame:
    """Edges (source, target, kind, repo, branch, file, line) with the id that their key gives."""
    return edges.withColumn("id", sha_prefix(F.concat_ws(":", "source", "target", "kind", "repo", "branch", "file"), 32)).select("id", "source", "target", "kind", "repo", "branch", "file", "line")


def store_run(run: dict[str, DataFrame | str], repo: str, branch: str, embed: Callable[[DataFrame], DataFrame], points: VersionedTable, edges: VersionedTable, records: VersionedTable, commit: str = "") -> None:
    """Write an ``index_repo`` run (made with keep) to its stores: files that went or were parsed again lose their points and edges, moved ones
    keep them under their new path, new ones are added. Records come last, so that a run that dies halfway is made again by the next one."""
    at = {"repo": F.lit(repo), "branch": F.lit(branch)}
    gone, moved = run["removed"].withColumns(at), run["moved"].withColumns(at)
    points.replace_files(gone, moved, points_of(run["chunks"], repo, branch, embed, commit))
    edges.replace_files(gone, moved, edge_rows(run["edges"].withColumnRenamed("source_file", "file").withColumns(at)), move=rename_edges)
    after = run["records"].withColumns(at | {"last_commit": F.lit(commit)}).withColumn("id", sha_prefix(F.concat_ws(":", "repo", "branch", "file"), 32))
    before = records.read()
    left = gone.limit(0) if before is None else before.where((F.col("repo") == repo) & (F.col("branch") == branch)).join(shuffled(after.select("file")), "file", "left_anti").select("repo", "branch", "file")
    records.replace_files(left, moved.limit(0), after, move=lambda old, moves: old)
