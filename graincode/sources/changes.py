"""File changes and contents: version-control listings, diffs and line ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def full_listing(tracked: DataFrame) -> DataFrame:
    """Every tracked path as added."""
    return tracked.select("path", F.lit("added").alias("status"), F.lit(None).cast("string").alias("old_path"))


def from_status(code: Column, first: Column, second: Column) -> list[Column]:
    """path, status, old_path of a diff entry: A, M, D, R (old, new), C (the copy is added); null for other codes."""
    letter = F.substring(code, 1, 1)
    status = F.when(letter.isin("A", "C"), "added").when(letter == "M", "modified").when(letter == "D", "deleted").when(letter == "R", "renamed")
    return [F.when(letter.isin("R", "C"), second).otherwise(first).alias("path"), status.alias("status"), F.when(letter == "R", first).alias("old_path")]


def parse_name_status(lines: DataFrame, column: str = "line") -> DataFrame:
    """path, status, old_path of diff lines with tabs between the fields; lines of other codes are left out."""
    part = lambda n: F.try_element_at(F.split(column, "\t", -1), F.lit(n))
    return lines.select(*from_status(part(1), part(2), part(3))).where("status IS NOT NULL AND path IS NOT NULL")


def dirty(diff: DataFrame, untracked: DataFrame) -> DataFrame:
    """Changes against the last commit, and untracked files as added."""
    return diff.unionByName(full_listing(untracked))


def branch_files(branch: DataFrame, base: DataFrame) -> DataFrame:
    """Files of a branch that the base does not have with the same hash."""
    return branch.join(base.select("path", "content_hash"), ["path", "content_hash"], "left_anti")


def read_lines(files: DataFrame, start: Column | int, end: Column | int, text: str = "content") -> DataFrame:
    """files with excerpt and error: lines start (from 1) to end (inclusive, clamped; 0: to the last); all if start is under 1."""
    s, e = (F.lit(x) if isinstance(x, int) else x for x in (start, end))
    lines = F.split(text, "\n", -1)
    n = F.size(lines)
    last = F.when(e <= 0, n).otherwise(F.least(e, n))
    beyond = s > n
    part = F.when(s <= 0, F.col(text)).when(~beyond, F.array_join(F.slice(lines, F.greatest(s, F.lit(1)), F.greatest(last - s + 1, F.lit(0))), "\n"))
    return files.withColumns({"excerpt": part, "error": F.when(beyond & (s > 0), F.lit("start line is beyond the end"))})


def glob_to_regex(glob: str) -> str:
    """A path glob: ** crosses folders, * and ? do not."""
    out, i = "", 0
    while i < len(glob):
        if glob[i : i + 3] == "**/":
            out, i = out + "(.*/)?", i + 3
        elif glob[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            out += "[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if not c.isalnum() and c not in "_/-" else c
            i += 1
    return f"^{out}$"


def exclude(files: DataFrame, globs: list[str], path: str = "path") -> DataFrame:
    for g in globs:
        files = files.where(~F.col(path).rlike(glob_to_regex(g)))
    return files


def read_tree(spark, root: str) -> DataFrame:
    """path and content of all files under a folder that Spark can read; bytes that are no UTF-8 are replaced."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return raw.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
