"""Streams: debounced file events, anchored deduplication, retry queue and health transitions.

Each operator has a batch form, and a streaming form whose final result is the same.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime, timezone
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Seconds of quiet that end a burst, and entries that wait for a retry at most.
QUIET_SECONDS, QUEUE_CAP = 5, 10_000


#: Endings of names that are never watched, and folders that are left out.
IGNORED_ENDINGS = ("~", ".swp", ".tmp")
IGNORED_FOLDERS = ("node_modules", "vendor", ".git", "__pycache__", "dist", "build", ".next", ".nuxt", "target", ".gradle")


def watchable(path: Column, folders: tuple[str, ...] = IGNORED_FOLDERS) -> Column:
    """Whether a path counts: its name starts with no dot and has none of the endings, and none of its folders is left out."""
    name = F.substring_index(path, "/", -1)
    ending = reduce(Column.__or__, [name.endswith(e) for e in IGNORED_ENDINGS])
    return ~(name.startswith(".") | ending | F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(f) for f in folders])))


def debounce(events: DataFrame, keys: list[str], quiet: str = f"{QUIET_SECONDS} seconds", time: str = "ts", path: str = "path") -> DataFrame:
    """One row for each burst of events of a key: a burst ends when nothing comes for ``quiet``. Works on batches and streams."""
    window = F.session_window(F.col(time), quiet)
    out = events.groupBy(*keys, window.alias("w")).agg(F.array_sort(F.collect_set(path)).alias("paths"), F.count(F.lit(1)).alias("events"))
    return out.select(*keys, F.col("w.start").alias("started"), F.col("w.end").alias("fires"), "paths", "events")


def debounce_stream(events: DataFrame, keys: list[str], quiet: str, delay: str, time: str = "ts", path: str = "path") -> DataFrame:
    return debounce(events.withWatermark(time, delay), keys, quiet, time, path)


#: Microseconds of a time after all saves (in 2255, which pandas can still tell): a save of it closes what is open.
END_OF_TIME = 9_000_000_000_000_000


class AnchorProcessor(StatefulProcessor):
    """Anchors of one key over event time. State: the anchor that is sure and its count, the times it does not cover, and the timer.

    The earliest time is sure to be an anchor once the watermark has passed it; what falls into its window is then only counted. A timer at
    the window's end hands the row on, and takes the next time as the anchor. The state of a key goes with its last timer.
    """

    def __init__(self, keys: list[str], gap: int, time: str):
        self.keys, self.gap, self.time = keys, gap, time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", "anchor long, n long, times array<long>, timer long")

    def _settle(self, key: tuple, new: list[int], watermark_ms: int) -> Iterator[pd.DataFrame]:
        """Hand on the rows whose windows the watermark has passed, and wait for the end of the next one."""
        anchor, n, times, timer = self.state.get() if self.state.exists() else (None, 0, [], None)
        passed, done = watermark_ms * 1000, []  # no save of this time or before comes any more
        if anchor is not None:
            n += sum(t < anchor + self.gap for t in new)
            new = [t for t in new if t >= anchor + self.gap]
        times = sorted([*times, *new])
        while True:
            if anchor is None and times and times[0] <= passed:
                anchor = times[0]
                n = bisect_left(times, anchor + self.gap)
                times = times[n:]
            if anchor is None or anchor + self.gap - 1 > passed:
                break
            done.append((*key, anchor, n))
            anchor, n = None, 0
        first = anchor if anchor is not None else times[0] if times else None
        due = None if first is None else -(-(first + self.gap) // 1000)
        if due != timer and timer is not None and timer > watermark_ms:
            self.handle.deleteTimer(timer)
        if due is None:
            self.state.clear()
        else:
            if due != timer:
                self.handle.registerTimer(due)
            self.state.update((anchor, n, times, due))
        if done:  # a frame for each key that has nothing to hand on takes most of the time
            yield pd.DataFrame(done, columns=[*self.keys, "anchor", "n"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [t for frame in rows for t in frame[self.time].tolist() if t < END_OF_TIME]
        if new:
            yield from self._settle(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._settle(key, [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def anchor_stream(saves: DataFrame, keys: list[str], delay: str, seconds: int = 900, time: str = "us") -> DataFrame:
    """keys, anchor, n: a row for each anchor, once the watermark has passed the end of its window (append mode).

    Saves may come in any order, in one batch or several, if they are at most ``delay`` late; later ones are left out, as every
    operator with a watermark does. A query over this needs the RocksDB state store (``rocksdb_state``).
    """
    kinds = ", ".join(f"{k} {saves.schema[k].dataType.simpleString()}" for k in keys)
    timed = saves.select(*keys, time, F.timestamp_micros(time).alias("_at")).withWatermark("_at", delay)
    return timed.groupBy(*keys).transformWithStateInPandas(AnchorProcessor(keys, seconds * 1_000_000, time), f"{kinds}, anchor long, n long", "Append", "EventTime")


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep state in RocksDB, which timers need; the session's own setting holds again after."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def run_to_end(stream: DataFrame, build: Callable[[DataFrame], DataFrame], last: dict, folder: str) -> DataFrame:
    """All rows that build(stream) hands on in append mode until the end of what the stream has now. folder is shared by the driver and all executors.

    The query runs to the end of its input, and once more, from its checkpoint, on one row more: the values of ``last``, whose time is after
    all others, null elsewhere; then everything that waits for the watermark is due.
    """
    spark, out = stream.sparkSession, f"{folder.rstrip('/')}/run-{uuid.uuid4().hex}"
    spark.createDataFrame([], stream.schema).write.parquet(f"{out}/end")
    rows = build(stream.unionByName(spark.readStream.schema(stream.schema).parquet(f"{out}/end")))
    for closing in (False, True):
        if closing:
            end = [F.lit(last.get(f.name)).cast(f.dataType).alias(f.name) for f in stream.schema.fields]
            spark.range(1).select(*end).write.mode("append").parquet(f"{out}/end")
        with rocksdb_state(spark):
            run = rows.writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{out}/rows")


def run_anchor_stream(saves: DataFrame, keys: list[str], folder: str, delay: str, seconds: int = 900, time: str = "us") -> DataFrame:
    """All rows of ``anchor_stream`` over what a stream of saves has now."""
    return run_to_end(saves.select(*keys, time), lambda s: anchor_stream(s, keys, delay, seconds, time), {time: END_OF_TIME}, folder)


def run_debounce_stream(events: DataFrame, keys: list[str], quiet: str, delay: str, folder: str, time: str = "ts", path: str = "path") -> DataFrame:
    """All bursts of ``debounce_stream`` over what a stream of events has now."""
    end = datetime.fromtimestamp(END_OF_TIME // 1_000_000, timezone.utc)
    out = run_to_end(events.select(*keys, time, path), lambda s: debounce_stream(s, keys, quiet, delay, time, path), {time: end}, folder)
    return out.where(F.col("started") < F.lit(end))


def replay(rows: DataFrame, folder: str, order: Column, parts: int, cuts: list | None = None) -> DataFrame:
    """rows as a stream of ``parts`` micro-batches, cut by ``order`` (at ``cuts``, where given): written to folder, which the driver and all executors share, one after the other."""
    out = f"{folder.rstrip('/')}/replay-{uuid.uuid4().hex}"
    if cuts is None:
        cuts = rows.select(F.percentile_approx(order, F.array(*[F.lit(k / parts) for k in range(1, parts)]), F.lit(10_000)).alias("c")).first()["c"] or []
    for low, high in zip([None, *cuts], [*cuts, None]):
        own = rows if low is None else rows.where(order > low)
        (own if high is None else own.where(order <= high)).coalesce(1).write.mode("append").parquet(out)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(out)


def bounded_queue(log: DataFrame, keys: list[str], order: str = "seq", cap: int = QUEUE_CAP) -> DataFrame:
    """The newest cap entries of each queue: older ones are dropped."""
    own = log.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order))))
    return own.where(F.col("_r") <= cap).drop("_r")


def flush(queue: DataFrame, keys: list[str], order: str = "seq", failed: str = "fails") -> DataFrame:
    """queue with state: entries before the first that fails are done, that one and the rest wait again."""
    first = queue.where(F.col(failed)).groupBy(*keys).agg(F.min(order).alias("_first"))
    own = queue.join(first, keys, "left")
    return own.withColumn("state", F.when(F.col("_first").isNull() | (F.col(order) < F.col("_first")), "done").otherwise("waiting")).drop("_first")


def transitions(checks: DataFrame, keys: list[str], time: list[str], healthy: str = "healthy") -> DataFrame:
    """Checks at which health changes; a store counts as healthy before its first check. up asks for a flush."""
    before = F.coalesce(F.lag(healthy).over(Window.partitionBy(*keys).orderBy(*time)), F.lit(True))
    own = checks.withColumn("_before", before).where(F.col("_before") != F.col(healthy))
    return own.withColumn("transition", F.when(F.col(healthy), "up").otherwise("down")).drop("_before")


class RetryLog:
    """Operations on stores that may be down: sent at once to one that is up, otherwise kept, and sent again, in order, when it comes up.

    A micro-batch has rows store, seq, healthy and operation: a row with healthy is a check of a store, the others are operations. Every batch leaves
    three tables in folder, which the driver and all executors share: ``outcomes``, the operations that were applied or dropped, ``waiting``, the queue after it, of the
    newest ``cap`` operations a store, and ``health``, the last check of each store. A batch reads only the tables of the batch before, so one
    that is run again gives the same tables; ``send`` (store, seq, operation, attempt), which raises where it fails, may then be called again
    and must not mind. Stores are served side by side, operations of a store one by one in order of seq.
    """

    _QUEUE = "store string, seq long, operation string, attempts long"

    def __init__(self, spark: SparkSession, folder: str, send: Callable[[str, int, str, int], None], cap: int = QUEUE_CAP):
        self.spark, self.folder, self.send, self.cap = spark, f"{folder.rstrip('/')}/retries-{uuid.uuid4().hex}", send, cap
        self.last = -1

    def _table(self, name: str, n: int, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema) if n < 0 else self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/batch={n}")

    def _write(self, rows: DataFrame, name: str, n: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={n}")

    def _sent(self, queue: DataFrame, stop: bool) -> DataFrame:
        """queue with state (applied, failed or not tried); stop: nothing of a store is tried after its first failure."""
        send = self.send

        def run(batches):
            failed = None
            for batch in batches:
                states = []
                for store, seq, operation, attempts in zip(*(c.to_pylist() for c in batch.columns)):
                    if stop and failed == (store,):
                        states.append("waiting")
                        continue
                    try:
                        send(store, seq, operation, attempts)
                        states.append("applied")
                    except Exception:  # noqa: BLE001  whatever a store raises
                        failed = (store,)
                        states.append("failed")
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(states, pa.string())], [*batch.schema.names, "state"])

        dealt = queue.select("store", "seq", "operation", "attempts").repartition("store").sortWithinPartitions("store", "seq")
        return dealt.mapInArrow(run, f"{self._QUEUE}, state string")

    def on_batch(self, batch: DataFrame, n: int) -> None:
        """What ``foreachBatch`` calls."""
        before = self._table("health", n - 1, "store string, healthy boolean")
        rows = batch.select(F.col("store").cast("string").alias("store"), F.col("seq").cast("long").alias("seq"), "healthy", "operation")
        order = Window.partitionBy("store").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
        known = rows.join(before.withColumnRenamed("healthy", "_was"), "store", "left")
        known = known.withColumn("up", F.coalesce(F.last("healthy", ignorenulls=True).over(order), "_was", F.lit(True)))
        checks = rows.where("healthy IS NOT NULL").groupBy("store").agg(F.max_by("healthy", "seq").alias("now"), F.bool_or(~F.col("healthy")).alias("fell"))
        state = before.withColumnRenamed("healthy", "was").join(checks, "store", "full")
        state = state.select("store", F.coalesce("was", F.lit(True)).alias("was"), F.coalesce("now", "was").alias("healthy"), F.coalesce("fell", F.lit(False)).alias("fell"))
        self._write(state.select("store", "healthy"), "health", n)
        rising = state.where("healthy AND (NOT was OR fell)").select("store")
        new = known.where("healthy IS NULL").select("store", "seq", "operation", F.lit(0).cast("long").alias("attempts"), "up")
        direct = self._kept(self._sent(new.where("up"), False), "direct", n)
        late = new.where("NOT up").drop("up").unionByName(direct.where("state = 'failed'").select("store", "seq", "operation", (F.col("attempts") + 1).alias("attempts")))
        queue = self._table("waiting", n - 1, self._QUEUE).unionByName(late)
        newest = queue.withColumn("_r", F.row_number().over(Window.partitionBy("store").orderBy(F.desc("seq"))))
        fits = newest.where(F.col("_r") <= self.cap).drop("_r")
        flushed = self._kept(self._sent(fits.join(rising, "store", "left_semi"), True), "flushed", n)
        left = flushed.where("state <> 'applied'").select("store", "seq", "operation", (F.col("attempts") + (F.col("state") == "failed").cast("long")).alias("attempts"))
        self._write(fits.join(rising, "store", "left_anti").unionByName(left), "waiting", n)
        done = direct.where("state = 'applied'").select("store", "seq", F.lit("direct").alias("state"))
        done = done.unionByName(flushed.where("state = 'applied'").select("store", "seq", F.lit("flushed").alias("state")))
        self.last = n
        self._write(done.unionByName(newest.where(F.col("_r") > self.cap).select("store", "seq", F.lit("dropped").alias("state"))), "outcomes", n)

    def _kept(self, sent: DataFrame, name: str, n: int) -> DataFrame:
        """Written, so that nothing is sent twice in a batch."""
        self._write(sent, name, n)
        return self._table(name, n, f"{self._QUEUE}, state string")

    def run(self, rows: DataFrame) -> DataFrame:
        """store, seq, state (direct, flushed, dropped or waiting) and batch of all operations of a stream, after its end."""
        none = "store string, seq long, state string, batch int"
        rows.writeStream.foreachBatch(self.on_batch).option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start().awaitTermination()
        if self.last < 0:
            return self.spark.createDataFrame([], none)
        done = self.spark.read.schema(none).option("basePath", f"{self.folder}/outcomes").parquet(f"{self.folder}/outcomes")
        rest = self._table("waiting", self.last, self._QUEUE).select("store", "seq", F.lit("waiting").alias("state"), F.lit(None).cast("int").alias("batch"))
        return done.unionByName(rest)


def watch(changes: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str):
    """Run on_batch (an index run) on what each trigger brings, once for all that is there."""
    return changes.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
