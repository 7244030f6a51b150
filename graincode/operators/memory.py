"""Long-term memory: saves folded to rows, upserts by topic, deduplication inside anchored windows, search and upkeep."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from graincode.functions.scalars import auto_title, normalized_hash
from graincode.functions.shared import kept

#: Fixed value: seconds from the first save during which equal saves are duplicates of it.
DEDUP_SECONDS = 900


def anchors(saves: DataFrame, keys: list[str], seconds: int = DEDUP_SECONDS, time: str = "us") -> DataFrame:
    """keys, anchor and n: a save starts a row when it comes ``seconds`` or more after the anchor of the one before; others add to n.

    Keys and times stream, sorted, through a fold that jumps from anchor to anchor and holds one of them: a key of any number of saves
    takes the memory of a batch.
    """
    gap = seconds * 1_000_000
    kinds = ", ".join(f"`{k}` {saves.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        key, anchor, n = None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            times, mark = np.asarray(batch.column(len(keys))), np.asarray(batch.column(len(keys) + 1))
            edges = [0, *(np.flatnonzero(mark[1:] != mark[:-1]) + 1).tolist(), len(mark)]
            rows, found = [], []

            def close():
                rows.append(key)
                found.append((anchor, n))

            for a, b in zip(edges, edges[1:]):
                own = tuple(batch.column(c)[a].as_py() for c in range(len(keys)))
                if own != key:
                    if anchor is not None:
                        close()
                    key, anchor, n = own, None, 0
                while a < b:
                    if anchor is None:
                        anchor = int(times[a])
                    to = a + int(np.searchsorted(times[a:b], anchor + gap))
                    n += to - a
                    a = to
                    if a < b:
                        close()
                        anchor, n = None, 0
            yield _anchor_rows(rows, found, schema)
        if anchor is not None:
            yield _anchor_rows([key], [(anchor, n)], schema)

    schema = to_arrow_schema(StructType.fromDDL(f"{kinds}, anchor long, n long"))
    mark = F.xxhash64(*keys)  # keys that share it and lie side by side are told apart only if the whole sort puts them apart: it leads the order
    picked = saves.select(*keys, F.col(time).cast("long").alias("_t"), mark.alias("_mark"))
    return picked.repartition(*keys).sortWithinPartitions("_mark", *keys, "_t").mapInArrow(run, f"{kinds}, anchor long, n long")


def _anchor_rows(keys: list[tuple], found: list[tuple[int, int]], schema: pa.Schema) -> pa.RecordBatch:
    columns = [*zip(*keys), *zip(*found)] if keys else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _same(keys: list[str], *more: str) -> Column:
    """Whether the frames named l and r agree in keys, nulls too, and in more columns."""
    return reduce(Column.__and__, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys] + [F.col(f"l.{c}") == F.col(f"r.{c}") for c in more])


def anchors_spread(saves: DataFrame, keys: list[str], seconds: int = DEDUP_SECONDS, time: str = "us") -> DataFrame:
    """As ``anchors``, for keys too large for one task: the work of a key is spread over slots of time as long as a window.

    Every time points to the first one that is a window or more behind it, which lies in the next slot or is the first after that. Times after a pause of a
    window are anchors whatever came before; from these, pointers of doubling length mark the rest in as many rounds as the longest chain has
    binary digits. A round joins by key and time, so that no key is hot; what a round makes is written to the shared folder.
    """
    gap = seconds * 1_000_000
    slot = lambda c: F.floor(F.col(c) / gap).cast("long")
    times = kept(saves.groupBy(*keys, F.col(time).cast("long").alias("t")).agg(F.count(F.lit(1)).alias("n")).withColumn("slot", F.floor(F.col("t") / gap).cast("long")))
    in_slot = lambda *order: Window.partitionBy(*keys, "slot").orderBy(*order)
    edges = kept(times.groupBy(*keys, "slot").agg(F.min("t").alias("first"), F.max("t").alias("last")))
    # the pointer of each time
    probes = times.select(*keys, (F.col("t") + gap).alias("at"), F.lit(1).alias("kind"), "t").withColumn("slot", slot("at"))
    both = times.select(*keys, F.col("t").alias("at"), F.lit(0).alias("kind"), "t", "slot").unionByName(probes)
    there = F.min(F.when(F.col("kind") == 0, F.col("at"))).over(in_slot(F.desc("at"), "kind").rowsBetween(Window.unboundedPreceding, 0))
    near = both.withColumn("there", there).where("kind = 1").select(*keys, "slot", "t", "there")
    slots = edges.select(*keys, "slot", "first").unionByName(edges.select(*keys, (F.col("slot") + 1).alias("slot"), F.lit(None).cast("long").alias("first")))
    slots = slots.groupBy(*keys, "slot").agg(F.min("first").alias("first"))
    later = F.min("first").over(Window.partitionBy(*keys).orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1))
    slots = slots.select(*keys, "slot", later.alias("later"))  # of a key as many as it has slots, whatever its saves
    jump = near.alias("l").join(slots.alias("r"), _same(keys, "slot"), "left").select(*[f"l.{k}" for k in keys], "l.t", F.coalesce("l.there", "r.later").alias("to"))
    jump = kept(jump.where("to IS NOT NULL"))
    # times after a pause
    before = edges.select(*keys, (F.col("slot") + 1).alias("slot"), F.col("last").alias("end"))
    own = times.withColumn("_prev", F.lag("t").over(in_slot("t")))
    heads = own.alias("l").join(before.alias("r"), _same(keys, "slot"), "left").where(F.coalesce(F.col("l.t") - F.coalesce("l._prev", "r.end") >= gap, F.lit(True)))
    marked = kept(heads.select(*[f"l.{k}" for k in keys], "l.t"))
    count = marked.count()
    while True:
        met = marked.alias("l").join(jump.alias("r"), _same(keys, "t")).select(*[f"l.{k}" for k in keys], F.col("r.to").alias("t"))
        marked = kept(marked.unionByName(met).distinct())
        last, count = count, marked.count()
        if count == last:
            break
        farther = jump.select(*keys, F.col("t").alias("to"), F.col("to").alias("far"))
        jump = kept(jump.alias("l").join(farther.alias("r"), _same(keys, "to")).select(*[f"l.{k}" for k in keys], "l.t", F.col("r.far").alias("to")))
    # every time goes to the last anchor before it
    points = marked.withColumns({"slot": slot("t"), "anchor": F.col("t"), "n": F.lit(0).cast("long")})
    ends = points.groupBy(*keys, (F.col("slot") + 1).alias("slot")).agg(F.max("anchor").alias("carried"))
    rows = times.withColumn("anchor", F.lit(None).cast("long")).unionByName(points)
    found = rows.withColumn("anchor", F.last("anchor", ignorenulls=True).over(in_slot("t", F.col("anchor").isNull()).rowsBetween(Window.unboundedPreceding, 0)))
    given = found.alias("l").join(ends.alias("r"), _same(keys, "slot"), "left").select(*[f"l.{k}" for k in keys], F.coalesce("l.anchor", "r.carried").alias("anchor"), "l.n")
    return given.groupBy(*keys, "anchor").agg(F.sum("n").alias("n"))


#: A row of the fold. first_event made it, content_event gave the content that it has now; changed tells rows that the saves made or changed.
_FOLD = "project string, scope string, row long, first_event long, content_event long, hash string, topic_key string, created long, updated long, revision long, duplicates long, changed boolean"
_FOLD_NAMES = [c.split()[0] for c in _FOLD.split(", ")]


class _Fold:
    """Rows of one (project, scope) that a later save may still change: those with a topic, and those created less than ``gap`` ago."""

    def __init__(self, key: tuple, gap: int):
        self.key, self.gap, self.count = key, gap, 0
        self.topics: dict[str, dict] = {}
        self.hashes: dict[str, list[dict]] = {}  # recent rows by their hash, in order of creation
        self.recent: deque[dict] = deque()

    def expire(self, us: int) -> Iterator[dict]:
        """Forget rows created ``gap`` or more before; those without a topic are final."""
        while self.recent and self.recent[0]["created"] <= us - self.gap:
            row = self.recent.popleft()
            left = [r for r in self.hashes[row["hash"]] if r is not row]
            if left:
                self.hashes[row["hash"]] = left
            else:
                del self.hashes[row["hash"]]
            if not self._by_topic(row):
                yield row

    def _by_topic(self, row: dict) -> bool:
        return row["topic_key"] is not None and self.topics.get(row["topic_key"]) is row

    def _hashed(self, row: dict, h: str) -> None:
        if row["created"] > row["updated"] - self.gap:  # recent: found by its new hash from now on
            self.hashes[row["hash"]] = [r for r in self.hashes[row["hash"]] if r is not row]
            if not self.hashes[row["hash"]]:
                del self.hashes[row["hash"]]
            self.hashes[h] = sorted([*self.hashes.get(h, ()), row], key=lambda r: (r["created"], r["row"]))
        row["hash"] = h

    def load(self, row: dict) -> Iterator[dict]:
        """A row from before the saves. Rows come in order of creation; of rows with one topic the newest is found by it."""
        self.count = max(self.count, row["row"] + 1)
        yield from self.expire(row["created"])
        self.hashes.setdefault(row["hash"], []).append(row)
        self.recent.append(row)
        if row["topic_key"]:
            before = self.topics.get(row["topic_key"])
            self.topics[row["topic_key"]] = row
            if before is not None and not any(before is r for r in self.hashes.get(before["hash"], ())):
                yield before

    def save(self, us: int, event: int, h: str, topic: str | None) -> None:
        row = self.topics.get(topic) if topic else None
        if row is not None:
            row["updated"], row["revision"], row["content_event"] = us, row["revision"] + 1, event
            self._hashed(row, h)
        elif h in self.hashes:
            row = self.hashes[h][-1]
            row["updated"], row["duplicates"] = us, row["duplicates"] + 1
        else:
            row = dict(zip(_FOLD_NAMES, (*self.key, self.count, event, event, h, topic or None, us, us, 1, 0)))
            self.count += 1
            self.hashes[h] = [row]
            self.recent.append(row)
            if topic:
                self.topics[topic] = row
        row["changed"] = True

    def rest(self) -> list[dict]:
        return [*self.topics.values(), *(r for r in self.recent if not self._by_topic(r))]


def save_fold(saves: DataFrame, seconds: int = DEDUP_SECONDS, stored: DataFrame | None = None) -> DataFrame:
    """Rows after all saves, by (project, scope) in order of (us, event_id), with the rows that were stored before them.

    A save with a topic that a row already has overwrites that row and raises its revision (its creation time stays); else a row
    with the same hash created less than ``seconds`` before counts a duplicate (a new topic is then not stored); else it is a new row.
    Sorted saves, without text, stream through the fold: it holds one row a topic and the rows of the last ``seconds``, not a project.
    Stored rows are live rows as this returns them; those that no save can meet any more pass by the fold.
    """
    gap = seconds * 1_000_000
    mine = saves.select("project", "scope", F.lit(1).alias("kind"), F.col("us").alias("at"), F.col("event_id").alias("seq"), "hash", "topic_key")
    names = _FOLD_NAMES[2:11]
    own, still = mine.withColumn("old", F.lit(None).cast(f"struct<{', '.join(c.replace(' ', ':') for c in _FOLD.split(', ')[2:11])}>")), None
    if stored is not None:
        start = saves.agg(F.min("us")).first()[0]
        past = F.coalesce("topic_key", F.lit("")).eqNullSafe("") & (F.col("created") <= (start or 0) - gap) if start is not None else F.lit(True)
        still = stored.where(past).select(*_FOLD_NAMES[:11], F.lit(False).alias("changed"))
        old = stored.where(~past).select("project", "scope", F.lit(0).alias("kind"), F.col("created").alias("at"), F.col("row").alias("seq"), "hash", "topic_key", F.struct(*names).alias("old"))
        own = own.unionByName(old)

    def run(batches):
        fold, done = None, []
        for batch in batches:
            for project, scope, kind, at, seq, h, topic, old in zip(*(c.to_pylist() for c in batch.columns)):
                if fold is None or fold.key != (project, scope):
                    done += fold.rest() if fold else []
                    fold = _Fold((project, scope), gap)
                if kind == 0:
                    done += fold.load({"project": project, "scope": scope, **old, "changed": False})
                    continue
                done += fold.expire(at)
                fold.save(at, seq, h, topic)
            yield pa.RecordBatch.from_pylist(done, schema)
            done = []
        if fold:
            yield pa.RecordBatch.from_pylist(fold.rest(), schema)

    schema = to_arrow_schema(StructType.fromDDL(_FOLD))
    dealt = own.repartition("project", "scope").sortWithinPartitions("project", "scope", "kind", "at", "seq")
    out = dealt.mapInArrow(run, _FOLD)
    return out if still is None else out.unionByName(still)


#: What a save gives a row; project, scope and topic stay those of the row.
SAVED_FIELDS = ("title", "content", "memory_type", "tags", "author", "repo", "branch", "files")


def vector_id(h: Column) -> Column:
    return F.concat(F.lit("mem_"), F.substring(h, 1, 24))


def save_rows(saves: DataFrame, seconds: int = DEDUP_SECONDS, stored: DataFrame | None = None) -> DataFrame:
    """Whole rows after saves (with those of ``SAVED_FIELDS`` that they have): what ``save_fold`` gives, every field of the save whose content a row holds, vector_id.

    Texts do not go through the fold: a changed row takes its fields from its save by event, an unchanged one from the stored row.
    """
    fields = [c for c in SAVED_FIELDS if c in saves.columns]
    folded = save_fold(saves, seconds, None if stored is None else stored.drop(*fields, "vector_id"))
    new = saves.select(F.col("event_id").alias("content_event"), F.struct(*fields).alias("_new"))
    rows = folded.join(new, "content_event", "left")
    if stored is not None:
        old = stored.select("project", "scope", "row", F.struct(*fields).alias("_old"))
        rows = rows.join(old, ["project", "scope", "row"], "left").withColumn("_new", F.coalesce("_new", "_old"))
    return rows.select(*_FOLD_NAMES, *[F.col(f"_new.{c}").alias(c) for c in fields], vector_id(F.col("hash")).alias("vector_id"))


def orphan_vectors(saves: DataFrame, after: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Ids of vectors that no row holds after saves: of contents that a topic save replaced, now or among the stored rows. Every save writes
    its vector, and equal contents share one whatever their project, so an id goes only when the last row that holds it is gone."""
    written = saves.select(vector_id(F.col("hash")).alias("vector_id"))
    if stored is not None:
        written = written.unionByName(stored.select("vector_id"))
    return written.distinct().join(after.select("vector_id").distinct(), "vector_id", "left_anti")


def topic_upsert(saves: DataFrame) -> DataFrame:
    """One row for each (project, scope, topic): the newest content, the number of saves as revision, the first creation."""
    own = saves.where(F.coalesce("topic_key", F.lit("")) != "")
    newest = F.max_by(F.struct("content", "memory_type"), F.struct("us", "event_id"))
    out = own.groupBy("project", "scope", "topic_key").agg(newest.alias("_n"), F.count(F.lit(1)).alias("revision"), F.min("us").alias("created"))
    return out.select("project", "scope", "topic_key", "_n.content", "_n.memory_type", "revision", "created")


def remember(saves: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Points for the vector store, rows for ``save_fold`` and rejected saves, of saves with memory_id, content, text, title, memory_type, scope, project, topic_key, tags, us.

    content or text must be given; an empty title is made of the content. The vector is that of title and content and is written first;
    its id follows from the hash of the content alone, so that equal contents share one. embed gives memory_id and vector of (memory_id, text).
    """
    blank = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), other)
    own = saves.withColumn("content", blank("content", F.coalesce("text", F.lit(""))))
    good = own.where("content <> ''").withColumns({"title": blank("title", auto_title(F.col("content"))), "memory_type": blank("memory_type", F.lit("note")), "scope": blank("scope", F.lit("shared"))})
    good = good.withColumn("hash", normalized_hash(F.col("content"))).withColumn("vector_id", F.concat(F.lit("mem_"), F.substring("hash", 1, 24)))
    vectors = embed(good.select("memory_id", F.concat_ws(" ", "title", "content").alias("text")))
    text = F.when(F.col("title") != "", F.concat_ws("\n", "title", "content")).otherwise(F.col("content"))
    points = good.join(vectors, "memory_id").select(
        F.col("vector_id").alias("id"), "vector", F.col("title").alias("symbol"), F.col("memory_type").alias("symbol_type"), F.lit("memory").alias("chunk_level"),
        F.substring("hash", 1, 16).alias("content_hash"), F.col("scope").alias("memory_scope"), "memory_type", F.col("tags").alias("memory_tags"), "project", "us", text.alias("text"),
    )
    points = points.groupBy("id").agg(F.max_by(F.struct(*[c for c in points.columns if c != "id"]), "us").alias("p")).select("id", *[f"p.{c}" for c in points.columns if c not in ("id", "us")])
    return points, good.drop("text"), own.where("content = ''").select("memory_id", F.lit("content or text is required").alias("error"))


def where_memory(points: DataFrame, scope: str | None = None, memory_type: str | None = None, project: str | None = None) -> DataFrame:
    """Points of memories, by scope (``all``, like none, is any), type and project."""
    own = points.where(F.col("chunk_level") == "memory")
    for name, value in (("memory_scope", None if scope == "all" else scope), ("memory_type", memory_type), ("project", project)):
        own = own if value is None else own.where(F.col(name) == value)
    return own


def recall(hits: DataFrame, memories: DataFrame) -> DataFrame:
    """Vector hits with their live memory, of which there is one at most for a vector id; unmatched hits stay with empty fields."""
    live = memories.where(~F.col("deleted")).groupBy("vector_id").agg(F.min_by(F.struct("title", "content", "memory_type"), "memory_id").alias("m"))
    own = hits.join(live, hits["id"] == live["vector_id"], "left")
    return own.select("id", "score", *[F.coalesce(f"m.{c}", F.lit("")).alias(c) for c in ("title", "content", "memory_type")], F.col("m").isNotNull().alias("found"))


def text_search(memories: DataFrame, words: str, limit: int = 20, project: str | None = None, memory_type: str | None = None, scope: str | None = None) -> DataFrame:
    """Live memories whose title, content or tags (where there are such) hold the words, newest first."""
    places = [F.col(c).ilike(f"%{words}%") for c in ("title", "content", "tags") if c in memories.columns]
    own = memories.where(~F.col("deleted") & reduce(Column.__or__, places))
    for name, value in (("project", project), ("memory_type", memory_type), ("scope", scope)):
        own = own if value is None else own.where(F.col(name) == value)
    return own.orderBy(F.desc("updated"), F.desc("memory_id")).limit(limit)


def by_id(memories: DataFrame, memory_id: int) -> DataFrame:
    """The live memory of an id."""
    return memories.where(~F.col("deleted") & (F.col("memory_id") == memory_id))


def hard_delete(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """Memories without those whose memory_id is in ids."""
    return memories.join(ids.select("memory_id").distinct(), "memory_id", "left_anti")


def recent(memories: DataFrame, limit: int = 20) -> DataFrame:
    return memories.where(~F.col("deleted")).orderBy(F.desc("created"), F.desc("memory_id")).limit(limit)


def by_topic(memories: DataFrame, topic: str, project: str | None = None) -> DataFrame:
    own = memories.where(~F.col("deleted") & (F.col("topic_key") == topic))
    own = own if project is None else own.where(F.col("project") == project)
    return own.orderBy(F.desc("updated"), F.desc("memory_id")).limit(1)


def soft_delete(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose memory_id is in ids become deleted."""
    marks = ids.select("memory_id").distinct().withColumn("_gone", F.lit(True))
    return memories.join(marks, "memory_id", "left").withColumn("deleted", F.col("deleted") | F.coalesce("_gone", F.lit(False))).drop("_gone")


#: Fixed value: the columns that an update may change.
UPDATABLE = ("title", "content", "memory_type", "tags", "files", "topic_key")


def partial_update(memories: DataFrame, changes: DataFrame) -> DataFrame:
    """Non-null fields of changes (memory_id and any of ``UPDATABLE``) replace those of rows, whose revision rises; hash and vector stay."""
    fields = [c for c in UPDATABLE if c in changes.columns and c in memories.columns]
    new = changes.select("memory_id", *[F.col(c).alias(f"_{c}") for c in fields], F.lit(1).alias("_one"))
    own = memories.join(new, "memory_id", "left")
    out = own.withColumns({c: F.coalesce(f"_{c}", c) for c in fields} | {"revision": F.col("revision") + F.coalesce("_one", F.lit(0))})
    return out.drop(*[f"_{c}" for c in fields], "_one")


def stats(memories: DataFrame) -> DataFrame:
    """Live rows in all, by type, and by project, in one pass."""
    live = memories.where(~F.col("deleted"))
    return live.groupingSets([["memory_type"], ["project"], []], "memory_type", "project").agg(F.count(F.lit(1)).alias("n"))
