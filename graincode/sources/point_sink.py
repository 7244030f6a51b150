"""The shared store as a data sink: points in batches of a thousand, with the failures of batches counted.

A task sends its batches one by one; one that fails is counted and the next one goes on. Every task's counts are its commit message, and the
commit adds them up by branch in a report. Sending is an upsert by id, so a task that runs again after a lost executor does no harm.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

#: Points of a batch, and errors that a report shows of a branch.
BATCH, SHOWN = 1000, 3
REPORT = "branch string, points long, failed_points long, batches long, failed_batches long, errors array<string>"


class FolderClient:
    """A store in a folder of any file system that pyarrow knows: a Parquet file for each batch, named by its ids."""

    def __init__(self, options: dict):
        self.files, self.path = fs.FileSystem.from_uri(options["target"])
        self.dimension = int(options["dimension"]) if options.get("dimension") else None

    def upsert(self, rows: list[dict]) -> None:
        wrong = [r["id"] for r in rows if self.dimension is not None and len(r["vector"] or ()) != self.dimension]
        if wrong:
            raise ValueError(f"vector dimension is not {self.dimension}: {wrong[0]}")
        name = hashlib.sha256("\n".join(r["id"] for r in rows).encode()).hexdigest()
        self.files.create_dir(self.path, recursive=True)
        part = f"{self.path}/_{name}-{uuid.uuid4().hex}"
        pq.write_table(pa.Table.from_pylist(rows), part, filesystem=self.files)
        self.files.move(part, f"{self.path}/{name}.parquet")


@dataclass
class Counts(WriterCommitMessage):
    """By branch: points, failed points, batches and failed batches, and some errors."""

    branches: dict[str, list[int]] = field(default_factory=dict)
    errors: dict[str, list[str]] = field(default_factory=dict)


class PointSink(DataSource):
    """Options: client (module:factory, called with the options), what the client needs, report (a URI), and by: columns whose change ends a batch."""

    @classmethod
    def name(cls) -> str:
        return "point_sink"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return PointWriter(dict(self.options))


class PointWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.options = options

    def write(self, iterator: Iterator[Row]) -> Counts:
        module, factory = self.options.get("client", "graincode.sources.point_sink:FolderClient").split(":")
        client, by = getattr(importlib.import_module(module), factory)(self.options), self.options.get("by", "branch").split(",")
        counts, batch, key = Counts(), [], None

        def send() -> None:
            if not batch:
                return
            branch = batch[0]["branch"] or ""
            own = counts.branches.setdefault(branch, [0, 0, 0, 0])
            try:
                client.upsert(batch)
                own[0], own[2] = own[0] + len(batch), own[2] + 1
            except Exception as e:  # noqa: BLE001  whatever a store raises: the batch is counted, the next one goes on
                own[1], own[3] = own[1] + len(batch), own[3] + 1
                counts.errors.setdefault(branch, []).append(str(e))
                del counts.errors[branch][SHOWN:]
            batch.clear()

        for row in iterator:
            now = tuple(row[c] for c in by)
            if now != key or len(batch) >= BATCH:
                send()
                key = now
            batch.append(row.asDict(recursive=True))
        send()
        return counts

    def commit(self, messages: list[Counts | None]) -> None:
        total, errors = {}, {}
        for m in filter(None, messages):
            for branch, n in m.branches.items():
                total[branch] = [a + b for a, b in zip(total.get(branch, (0, 0, 0, 0)), n)]
            for branch, e in m.errors.items():
                errors[branch] = sorted([*errors.get(branch, ()), *e])[:SHOWN]
        lines = [json.dumps(dict(zip(("branch", "points", "failed_points", "batches", "failed_batches"), (b, *n))) | {"errors": errors.get(b, [])}) for b, n in sorted(total.items())]
        files, path = fs.FileSystem.from_uri(self.options["report"])
        files.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with files.open_output_stream(path) as out:
            out.write("\n".join(lines).encode())

    def abort(self, messages: list[Counts | None]) -> None:
        pass


def push_batches(points: DataFrame, folder: str, options: dict[str, str], by: tuple[str, ...] = ("branch",)) -> DataFrame:
    """Send points (id, branch, and what the client stores) and return the report: by branch, points and batches that were stored and that failed.

    Batches do not mix values of ``by``, which start with branch and also deal the points to tasks: more columns spread a large branch. folder
    is a URI that the driver and all executors share.
    """
    spark, report = points.sparkSession, f"{folder.rstrip('/')}/report-{uuid.uuid4().hex}.json"
    spark.dataSource.register(PointSink)
    dealt = points.repartition(*by).sortWithinPartitions(*by, "id")
    dealt.write.format("point_sink").mode("append").options(**options, by=",".join(by), report=report).save()
    return spark.read.schema(REPORT).json(report).where(F.col("branch").isNotNull())
