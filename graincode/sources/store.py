"""The vector table as versioned Parquet: scans, upserts, deletes and renames without overwriting what is read."""

from __future__ import annotations

import json
import re
import uuid
from collections import deque
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graincode.functions.scalars import deterministic_id, uuid5
from graincode.functions.shared import shuffled
from graincode.sources.config import Settings

DEFAULTS = {"symbol": "", "symbol_type": "", "language": "", "content_hash": "", "is_deletion": False}


def scroll(points: DataFrame, repo: str, branch: str = "") -> DataFrame:
    """All points of a repo, or of one of its branches."""
    own = points.where(F.col("repo") == repo)
    return own if branch == "" else own.where(F.col("branch") == branch)


def with_defaults(points: DataFrame) -> DataFrame:
    return points.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in DEFAULTS.items() if c in points.columns})


def upsert(old: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """Points after replacing those with an id of new; of equal ids in new the last by order stays."""
    new = with_defaults(new)
    if order is not None:
        rest = [c for c in new.columns if c != "id"]
        new = new.groupBy("id").agg(F.max_by(F.struct(*rest), order).alias("_n")).select("id", *[f"_n.{c}" for c in rest])
    return old.join(shuffled(new.select("id")), "id", "left_anti").unionByName(new)


def delete_files(points: DataFrame, gone: DataFrame) -> DataFrame:
    """Points without those of the (repo, branch, file) of gone."""
    return points.join(shuffled(gone.select("repo", "branch", "file").distinct()), ["repo", "branch", "file"], "left_anti")


def rename_files(points: DataFrame, renames: DataFrame) -> DataFrame:
    """Points of renamed files (repo, branch, file, new_file) move with a new id; nothing is lost."""
    own = points.join(shuffled(renames.select("repo", "branch", "file", "new_file")), ["repo", "branch", "file"], "left")
    moved = deterministic_id(F.col("repo"), F.col("branch"), F.col("new_file"), F.col("start_line"))
    return own.withColumns({"id": F.when(F.col("new_file").isNotNull(), moved).otherwise(F.col("id")), "file": F.coalesce("new_file", "file")}).drop("new_file")


def require_dimension(points: DataFrame, dimension: int) -> DataFrame:
    """Fails the job on a vector of another dimension."""
    wrong = F.raise_error(F.lit(f"vector dimension is not {dimension}"))
    return points.withColumn("vector", F.when(F.size("vector") == dimension, F.col("vector")).otherwise(wrong))


def to_shared(points: DataFrame) -> DataFrame:
    """Points as the shared store keys them: a UUID of the id, which stays in original_id."""
    return points.withColumns({"original_id": F.col("id"), "id": uuid5(F.col("id"))})


class WriteConflict(RuntimeError):
    """Another writer made the next version first; what is there is as that one left it, and the change can be made again."""


class VersionedTable:
    """Rows in buckets by their keys, in Parquet; a version is a manifest that names the folder of each bucket.

    A change writes the buckets that it touches, then its manifest under a name of its own, and then renames that to the next version, which
    must not be there yet: of two writers one gets WriteConflict. A writer that dies at any point leaves the version before it, and a manifest
    that is not whole is passed over. Needs a file system that renames files in one step, as HDFS does. Readers keep what they read.
    """

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...] = ("repo", "branch"), buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets

    def _at(self, name: str):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self) -> list[str]:
        fs, at = self._at("manifests")
        names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        return sorted((n for n in names if re.fullmatch(r"\d{12}\.json", n)), reverse=True)

    def _manifest(self) -> tuple[int, dict[str, str]]:
        """Number of the current version (0: none), and the folder of each bucket that has rows."""
        names = self._names()
        for name in names:
            rows = self.spark.read.text(f"{self.path}/manifests/{name}", wholetext=True).head(1)
            try:
                folders = json.loads(rows[0][0] if rows else "")
            except ValueError:
                continue
            return int(names[0].split(".")[0]), folders
        return (int(names[0].split(".")[0]) if names else 0), {}

    def _commit(self, n: int, folders: dict[str, str]) -> None:
        fs, own = self._at(f"manifests/_{uuid.uuid4().hex}")
        _, at = self._at(f"manifests/{n:012d}.json")
        out = fs.create(own, False)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        options = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)  # none: what is there is not replaced
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.spark._jsc.hadoopConfiguration()).rename(own, at, options)
        except Exception as e:
            fs.delete(own, False)
            if "AlreadyExists" in str(e):
                raise WriteConflict(str(at)) from e
            raise

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _load(self, folders: dict[str, str], schema) -> DataFrame | None:
        return self.spark.read.schema(schema).parquet(*sorted(folders.values())) if folders else None

    def _schema(self, folders: dict[str, str]):
        return self.spark.read.parquet(next(iter(folders.values()))).schema if folders else None

    def read(self) -> DataFrame | None:
        folders = self._manifest()[1]
        return self._load(folders, self._schema(folders))

    def count(self) -> int:
        rows = self.read()
        return 0 if rows is None else rows.count()

    def _change(self, touched: DataFrame, change: Callable[[DataFrame], DataFrame], schema=None) -> None:
        """Replace the buckets of the keys in touched by change of their rows."""
        n, folders = self._manifest()
        schema = schema or self._schema(folders)
        buckets = {str(r[0]) for r in touched.select(self._bucket()).distinct().collect()}  # self.buckets at most
        if not buckets or schema is None:
            return
        old = self._load({b: f for b, f in folders.items() if b in buckets}, schema)
        version = f"data/{uuid.uuid4().hex}"
        rows = change(self.spark.createDataFrame([], schema) if old is None else old).select(*schema.names)
        dealt = rows.withColumn("_bucket", self._bucket()).hint("rebalance", "_bucket")  # a bucket of many rows goes to several tasks
        dealt.write.partitionBy("_bucket").parquet(f"{self.path}/{version}")
        made = {b: f"{version}/_bucket={b}" for b in buckets}
        new = {b: f"{self.path}/{f}" for b, f in made.items() if (lambda x: x[0].exists(x[1]))(self._at(f))}
        self._commit(n + 1, {b: f for b, f in folders.items() if b not in buckets} | new)

    def upsert(self, new: DataFrame, order: str | None = None) -> None:
        """Replace rows by id; rows of an id have the same keys in every version."""
        self._change(new, lambda old: upsert(old, new, order), None if self._manifest()[1] else with_defaults(new).schema)

    def delete_files(self, gone: DataFrame) -> None:
        self._change(gone, lambda old: delete_files(old, gone))

    def rename_files(self, renames: DataFrame) -> None:
        self._change(renames, lambda old: rename_files(old, renames))

    def replace_files(self, gone: DataFrame, moves: DataFrame, new: DataFrame, order: str | None = None, move: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> None:
        """One version in which files (repo, branch, file) are gone, others have moved (with new_file), and new rows are there."""
        keys = list(self.keys)
        touched = gone.select(*keys).union(moves.select(*keys)).union(new.select(*keys))
        schema = None if self._manifest()[1] else with_defaults(new).drop(*[order] if order else []).schema
        self._change(touched, lambda old: upsert((move or rename_files)(delete_files(old, gone), moves), new, order), schema)

    def drop(self) -> None:
        fs, at = self._at("")
        fs.delete(at, True)

    def vacuum(self) -> int:
        """Remove the folders that the current version does not name (readers of older versions lose them); how many there were."""
        named = {f.split("/data/")[1].split("/")[0] for f in self._manifest()[1].values()}
        fs, at = self._at("data")
        gone = [x.getPath() for x in fs.listStatus(at) if x.getPath().getName() not in named] if fs.exists(at) else []
        for x in gone:
            fs.delete(x, True)
        return len(gone)


#: What a store that cannot be reached raises: of the system, or of Spark's side.
DOWN = (OSError, PySparkException, Py4JError)


class HybridTable:
    """Two stores that are written in turn, local first; changes that the shared one fails to take wait in a bounded log, oldest first."""

    def __init__(self, local: VersionedTable, shared: VersionedTable, cap: int = 10_000):
        self.local, self.shared, self.log = local, shared, deque(maxlen=cap)

    def _both(self, name: str, batch: DataFrame) -> None:
        getattr(self.local, name)(batch)
        try:
            getattr(self.shared, name)(batch)
        except DOWN as e:
            if isinstance(e, (AnalysisException, WriteConflict)):
                raise  # a wrong batch or another writer, not a store that is down
            self.log.append((name, batch, str(e)))

    def upsert(self, batch: DataFrame) -> None:
        self._both("upsert", batch)

    def delete_files(self, gone: DataFrame) -> None:
        self._both("delete_files", gone)

    def rename_files(self, renames: DataFrame) -> None:
        self._both("rename_files", renames)

    def flush(self) -> int:
        """Make the waiting changes, in order, up to the first that fails again; how many were made."""
        done = 0
        while self.log:
            name, batch, _ = self.log[0]
            try:
                getattr(self.shared, name)(batch)
            except DOWN as e:
                self.log[0] = (name, batch, str(e))
                break
            self.log.popleft()
            done += 1
        return done

    def read(self) -> DataFrame | None:
        return self.local.read()


def open_store(spark: SparkSession, own: Settings) -> VersionedTable | HybridTable:
    """The store that checked settings name. The shared one is a table at an address that Spark can write to."""
    own = own.check()
    if own.mode == "hybrid":
        return HybridTable(VersionedTable(spark, own.local_path), VersionedTable(spark, own.shared_url))
    return VersionedTable(spark, own.local_path if own.mode == "local" else own.shared_url)
