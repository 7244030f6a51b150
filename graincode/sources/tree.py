"""File trees as data sources: working trees and commits read on executors by path ranges, and a stream of what changes in a tree.

The trees lie on a file system that driver and executors mount, as repositories do; trees in object stores are read by ``changes.read_tree``.
"""

from __future__ import annotations

import os
import subprocess
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Folders that are left out unless the option ``skip`` says otherwise, path ranges unless ``ranges`` does, and bytes of contents in a batch.
SKIPPED, RANGES, BATCH_BYTES = ".git", 32, 8 << 20


@dataclass
class PathRange(InputPartition):
    """Entries in order of path: a folder with all below it, or (not deep) the files of a folder alone. after and until bound times, in nanoseconds."""

    entries: tuple[tuple[str, bool], ...]
    after: int = 0
    until: int = 0


class Folder:
    """A folder of the file system. Paths are relative to it, with slashes."""

    def __init__(self, root: str, skip: frozenset[str]):
        self.root, self.skip = root, skip

    def _scan(self, at: str) -> list[os.DirEntry]:
        with os.scandir(os.path.join(self.root, at)) as found:
            return sorted(found, key=lambda e: e.name)

    def folders(self, at: str) -> list[str]:
        return [f"{at}/{e.name}".lstrip("/") for e in self._scan(at) if e.is_dir(follow_symlinks=False) and e.name not in self.skip]

    def files(self, at: str, deep: bool) -> Iterator[str]:
        try:
            found = self._scan(at)
        except FileNotFoundError:  # it went meanwhile
            return
        for e in found:
            path = f"{at}/{e.name}".lstrip("/")
            if e.is_dir(follow_symlinks=False):
                if deep and e.name not in self.skip:
                    yield from self.files(path, True)
            elif e.is_file(follow_symlinks=False):
                yield path

    def contents(self, paths: Iterator[str]) -> Iterator[tuple[str, bytes]]:
        for path in paths:
            try:
                with open(os.path.join(self.root, path), "rb") as f:
                    yield path, f.read()
            except FileNotFoundError:
                continue


class Commit:
    """A commit of a repository, through git on the machine that reads."""

    def __init__(self, root: str, commit: str):
        self.root, self.commit = root, commit

    def _git(self, *args: str) -> list[str]:
        done = subprocess.run(["git", "-C", self.root, *args], capture_output=True, check=False)
        if done.returncode:
            raise RuntimeError(f"git {args[0]}: {done.stderr.decode(errors='replace').strip()}")
        return done.stdout.decode(errors="surrogateescape").split("\0")[:-1]

    def _entries(self, at: str, *options: str) -> list[tuple[str, str]]:
        """Kind and path."""
        lines = self._git("ls-tree", "-z", *options, self.commit, *([f"{at}/"] if at else []))
        return [(head.split()[1], path) for head, path in (x.split("\t", 1) for x in lines)]

    def folders(self, at: str) -> list[str]:
        return sorted(path for kind, path in self._entries(at) if kind == "tree")

    def files(self, at: str, deep: bool) -> Iterator[str]:
        yield from sorted(path for kind, path in self._entries(at, *["-r"] * deep) if kind == "blob")

    def contents(self, paths: Iterator[str]) -> Iterator[tuple[str, bytes]]:
        """Through one process for all paths of a range."""
        with subprocess.Popen(["git", "-C", self.root, "cat-file", "--batch", "-z"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as git:
            for path in paths:
                git.stdin.write(f"{self.commit}:{path}".encode(errors="surrogateescape") + b"\0")
                git.stdin.flush()
                size = int(git.stdout.readline().split()[2])
                yield path, git.stdout.read(size + 1)[:-1]
            git.stdin.close()


def path_ranges(tree: Folder | Commit, ranges: int) -> list[tuple[tuple[str, bool], ...]]:
    """The tree in about so many ranges: folders are opened, level by level, until there are enough of them."""
    closed, level = [], [""]
    while level and len(closed) + len(level) < 4 * ranges:
        opened = {at: tree.folders(at) for at in level}
        closed += [(at, False) for at in level]
        level = [x for below in opened.values() for x in below]
    entries = sorted([*closed, *((at, True) for at in level)])
    size = -(-len(entries) // ranges)
    return [tuple(entries[i : i + size]) for i in range(0, len(entries), size)]


def _tree(options: dict) -> Folder | Commit:
    root = options["path"].removeprefix("file:")
    return Commit(root, options["commit"]) if options.get("commit") else Folder(root, frozenset(options.get("skip", SKIPPED).split(",")))


class TreeSource(DataSource):
    """path, bytes and content (null with the option ``content`` = false, and bytes too) of every file of a folder, or of a ``commit``."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, bytes long, content string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return TreeReader(dict(self.options))


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[PathRange]:
        return [PathRange(r) for r in path_ranges(_tree(self.options), int(self.options.get("ranges", RANGES)))]

    def read(self, partition: PathRange) -> Iterator[pa.RecordBatch]:
        tree, rows, size = _tree(self.options), [], 0
        paths = (path for at, deep in partition.entries for path in tree.files(at, deep))
        names = ["path", "bytes", "content"]
        shown = lambda path: path.encode(errors="surrogateescape").decode(errors="replace")
        found = tree.contents(paths) if self.options.get("content", "true") == "true" else ((path, None) for path in paths)
        for path, content in found:
            rows.append((shown(path), None if content is None else len(content), None if content is None else content.decode(errors="replace")))
            size += len(content or b"") + len(path)
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.string()))], names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.string()))], names)


class WatchSource(DataSource):
    """A stream of path, kind (file or folder) and ts of what changed in a folder since ``since`` (seconds; 0: all that is there).

    Offsets are times: a batch has what was last changed after one and not after the other, whether it was committed or not. A file that
    is removed or renamed changes its folder, which is then listed and compared with what is known.
    """

    @classmethod
    def name(cls) -> str:
        return "source_watch"

    def schema(self) -> str:
        return "path string, kind string, ts timestamp"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return WatchReader(dict(self.options))


class WatchReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:  # noqa: N802
        return {"ns": int(float(self.options.get("since", "0")) * 1_000_000_000)}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"ns": time.time_ns()}

    def partitions(self, start: dict, end: dict) -> list[PathRange]:
        return [PathRange(r, start["ns"], end["ns"]) for r in path_ranges(_tree(self.options), int(self.options.get("ranges", RANGES)))]

    def read(self, partition: PathRange) -> Iterator[tuple]:
        from datetime import datetime, timezone

        tree = _tree(self.options)

        def changed(path: str, kind: str) -> Iterator[tuple]:
            try:
                at = os.stat(os.path.join(tree.root, path), follow_symlinks=False).st_mtime_ns
            except FileNotFoundError:
                return
            if partition.after < at <= partition.until:
                yield path, kind, datetime.fromtimestamp(at / 1e9, timezone.utc)

        for at, deep in partition.entries:
            below = [at]
            while below:
                folder = below.pop()
                yield from changed(folder, "folder")
                for path in tree.files(folder, False):
                    yield from changed(path, "file")
                if deep and os.path.isdir(os.path.join(tree.root, folder)):
                    below += tree.folders(folder)

    def commit(self, end: dict) -> None:
        pass


def register(spark: SparkSession) -> None:
    """Make both sources known to a session, by their names."""
    spark.dataSource.register(TreeSource)
    spark.dataSource.register(WatchSource)
