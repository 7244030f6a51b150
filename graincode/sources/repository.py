"""Version-control repositories: state, changes, contents and branch lineage, read through the git command on the driver."""

from __future__ import annotations

import subprocess
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graincode.sources import tree
from graincode.sources.changes import dirty, from_status, full_listing

#: Branches that can be the root of a lineage, in order; seconds that a command may take.
ROOTS, TIMEOUT = ("main", "master"), 30


@dataclass(frozen=True)
class State:
    commit: str
    branch: str
    detached: bool
    dirty: tuple[str, ...]


def dirty_path(line: Column) -> Column:
    """Path of a line of a short status (two letters, a space, the path); a rename counts as its new path."""
    path = F.substring(line, 4, 1 << 30)
    return F.when(F.contains(path, F.lit(" -> ")), F.regexp_extract(path, r"^.* -> (.*)$", 1)).otherwise(path)


def dirty_files(lines: DataFrame, column: str = "line") -> DataFrame:
    """path of each line of a short status that names one."""
    return lines.where(F.length(column) > 3).select(dirty_path(F.col(column)).alias("path"))


class Repository:
    """One working tree. ``run`` gives the output of a git command and raises RuntimeError where it fails."""

    def __init__(self, path: str, run: Callable[..., str] | None = None):
        self.path, self.run = path, run or self._git

    def _git(self, *args: str) -> str:
        done = subprocess.run(["git", "-C", self.path, *args], capture_output=True, timeout=TIMEOUT, check=False)
        if done.returncode:
            raise RuntimeError(f"git {args[0]}: {done.stderr.decode(errors='replace').strip()}")
        return done.stdout.decode(errors="replace")

    def _fields(self, *args: str) -> list[str]:
        """Fields of an output that ends each with a NUL, so that any path comes as it is."""
        return self.run(*args).split("\0")[:-1]

    def _paths(self, spark: SparkSession, *args: str) -> DataFrame:
        return spark.createDataFrame([(x,) for x in self._fields(*args)], "path string")

    def _diff(self, spark: SparkSession, *commits: str) -> DataFrame:
        fields, rows = iter(self._fields("diff", "--name-status", "-z", "-M", *commits)), []
        for code in fields:
            rows.append((code, next(fields), next(fields) if code[:1] in "RC" else None))
        made = spark.createDataFrame(rows, "code string, first string, second string")
        return made.select(*from_status(F.col("code"), F.col("first"), F.col("second"))).where("status IS NOT NULL")

    def state(self) -> State:
        """Commit, branch and dirty files: of folders that are not tracked every file, of a rename the new path."""
        branch = self.run("rev-parse", "--abbrev-ref", "HEAD").strip()
        fields, short = iter(self._fields("status", "--porcelain", "-z", "-u")), []
        for entry in fields:
            short.append(entry[3:])
            if set(entry[:2]) & set("RC"):
                next(fields)  # the old path
        return State(self.run("rev-parse", "HEAD").strip(), branch, branch == "HEAD", tuple(short))

    def files(self, spark: SparkSession, commit: str | None = None, content: bool = True) -> DataFrame:
        """path, bytes and content of all files of the working tree, or of a commit: listed and read by tasks, in ranges of paths."""
        tree.register(spark)
        options = {"content": str(content).lower()} | ({"commit": commit} if commit else {})
        return spark.read.format(tree.TreeSource.name()).options(**options).load(self.path)

    def changes(self, spark: SparkSession, old: str | None, new: str = "HEAD") -> DataFrame:
        """path, status, old_path between two commits; without an old one every tracked path is added."""
        if old is None:
            return full_listing(self.files(spark, new, content=False))
        return self._diff(spark, old, new)

    def uncommitted(self, spark: SparkSession) -> DataFrame:
        """Changes of the working tree against the last commit, and untracked files."""
        return dirty(self._diff(spark, "HEAD"), self._paths(spark, "ls-files", "-z", "--others", "--exclude-standard"))

    def content(self, path: str, commit: str) -> str | None:
        """A file at a commit; null where it is not there."""
        try:
            return self.run("show", f"{commit}:{path}")
        except RuntimeError:
            return None

    def lineage(self) -> list[tuple[str, int]]:
        """(branch, priority): the current branch (detached: the short commit), and the root branch if the two share a commit."""
        current = self.run("rev-parse", "--abbrev-ref", "HEAD").strip()
        if current == "HEAD":
            current = self.run("rev-parse", "--short", "HEAD").strip()
        root = next((r for r in ROOTS if self._has("rev-parse", "--verify", r)), ROOTS[0])
        return [(current, 0)] + ([(root, 1)] if current != root and self._has("merge-base", current, root) else [])

    def _has(self, *args: str) -> bool:
        try:
            return bool(self.run(*args).strip())
        except RuntimeError:
            return False


#: What a repository runs after each commit.
HOOK = "#!/bin/sh\n{command} --repo \"$(git rev-parse --show-toplevel)\" --incremental >/dev/null 2>&1 &\n"


def post_commit_hook(command: str) -> str:
    """Text of a hook that indexes after each commit, without holding it up."""
    return HOOK.format(command=command)
