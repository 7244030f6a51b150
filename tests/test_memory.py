"""Memory rows saved in several runs, orphaned vectors, anchors of hot keys, and the stream of saves against the batch."""

import glob
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graincode.operators import memory, vector
from graincode.streaming import operators as streams

SAVE = "project string, scope string, us long, event_id long, hash string, topic_key string, title string, content string, tags string"


def some_saves(seed, n=300):
    rng = random.Random(seed)
    rows = [(rng.choice("pq"), "s", rng.randrange(8000) * 10**6, i, rng.choice("abcdef") * 30, rng.choice([None, None, "t", "u", ""]), f"title {i}", f"content {i}", f"g{i % 3}") for i in range(n)]
    return sorted(rows, key=lambda r: r[2:4])


def plain_rows(rows, gap):
    """The three-way save one at a time, with whole rows."""
    out = []
    for project, scope, us, event, h, topic, title, content, tags in rows:
        live = [r for r in out if (r["project"], r["scope"]) == (project, scope)]
        same = [r for r in live if topic and r["topic_key"] == topic]
        near = [r for r in live if r["hash"] == h and r["created"] > us - gap]
        given = {"hash": h, "title": title, "content": content, "tags": tags, "content_event": event}
        if same:
            same[0].update(given, updated=us, revision=same[0]["revision"] + 1)
        elif near:
            near[-1].update(updated=us, duplicates=near[-1]["duplicates"] + 1)
        else:
            out.append({"project": project, "scope": scope, "row": len(live), "first_event": event, "topic_key": topic or None, "created": us, "updated": us, "revision": 1, "duplicates": 0, **given})
    return out


@pytest.mark.parametrize("cuts", [[], [100], [1, 90, 91, 250], [300]])
def test_rows_saved_in_runs(spark, cuts):
    """Any number of runs, each on top of what the one before stored, gives the rows of one save after another."""
    rows, gap = some_saves(1), 900 * 10**6
    stored = None
    for a, b in zip([0, *cuts], [*cuts, len(rows)]):
        own = spark.createDataFrame(rows[a:b], SAVE)
        after = memory.save_rows(own, stored=stored)
        if stored is not None and a == b:
            assert after.where("changed").count() == 0
        stored = spark.createDataFrame(after.collect(), after.schema)
    names = ["project", "scope", "row", "first_event", "content_event", "hash", "topic_key", "created", "updated", "revision", "duplicates", "title", "content", "tags"]
    got = Counter(tuple(r[c] for c in names) for r in stored.collect())
    assert got == Counter(tuple(r[c] for c in names) for r in plain_rows(rows, gap))
    assert all(r["vector_id"] == "mem_" + r["hash"][:24] for r in stored.collect())


def test_changed_rows_only(spark):
    first = memory.save_rows(spark.createDataFrame([("p", "s", 0, 1, "a" * 30, None, "t", "c", "g"), ("p", "s", 1, 2, "b" * 30, "k", "t2", "c2", "g")], SAVE))
    stored = spark.createDataFrame(first.collect(), first.schema)
    late = spark.createDataFrame([("p", "s", 10, 3, "c" * 30, "k", "t3", "c3", "h")], SAVE)
    after = memory.save_rows(late, stored=stored)
    assert [(r["row"], r["title"], r["content"], r["tags"], r["revision"], r["created"]) for r in after.where("changed").collect()] == [(1, "t3", "c3", "h", 2, 1)]
    assert [r["vector_id"] for r in memory.orphan_vectors(late, after, stored).collect()] == ["mem_" + "b" * 24]
    shared = spark.createDataFrame([("q", "s", 10, 4, "b" * 30, None, "t", "c", "g"), ("p", "s", 11, 5, "c" * 30, "k", "t3", "c3", "h")], SAVE)
    assert memory.orphan_vectors(shared, memory.save_rows(shared, stored=stored), stored).count() == 0  # another project holds the content


def test_anchors_stream_through_batches(spark):
    """A key of many saves, in Arrow batches of a few rows, beside keys that are null or odd."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        rng, rows = random.Random(3), []
        rows = [("hot", 1, rng.randrange(10**6) * 10**6) for _ in range(4000)] + [(None, 2, 5), (None, None, 5), ("", 2, 7), ("x", 1, -(10**12))] * 2
        want = Counter()
        for key in {r[:2] for r in rows}:
            anchor = None
            for t in sorted(r[2] for r in rows if r[:2] == key):
                anchor = t if anchor is None or t - anchor >= 900 * 10**6 else anchor
                want[*key, anchor] += 1
        got = memory.anchors(spark.createDataFrame(rows, "a string, b int, us long"), ["a", "b"])
        assert Counter({tuple(r)[:3]: r["n"] for r in got.collect()}) == want
        assert memory.anchors(spark.createDataFrame(rows, "a string, b int, us long").limit(0), ["a", "b"]).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("seed", [1, 2])
def test_anchors_spread_over_tasks(spark, seed):
    """Long chains, pauses, times at the very end of a window, equal times and null keys."""
    rng = random.Random(seed)
    rows = [("hot", rng.randrange(0, 200_000) * 10**6) for _ in range(1500)] + [("edge", k * 900 * 10**6) for k in range(40)] + [("edge", 900 * 10**6 - 1), ("x", -5), ("x", -5), (None, 7)]
    rows += [("pause", t * 10**6) for t in (0, 899, 900, 1799, 1800, 10_000, 10_899, 50_000)]
    saves = spark.createDataFrame(rows, "k string, us long")
    got = memory.anchors_spread(saves, ["k"])
    assert Counter(tuple(r) for r in got.collect()) == Counter(tuple(r) for r in memory.anchors(saves, ["k"]).collect())
    assert memory.anchors_spread(saves.limit(0), ["k"]).count() == 0


def test_stream_with_timers(spark, tmp_path):
    """Saves up to 30 minutes out of order over four micro-batches: the rows of the batch form, each once, and no state left."""
    rng = random.Random(3)
    rows = sorted(((t := rng.randrange(60_000) * 10**6) + rng.randrange(1800) * 10**6, rng.choice(["a", "b", None]), t) for _ in range(400))
    saves = spark.createDataFrame(rows, "comes long, project string, us long")
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    got = streams.run_anchor_stream(streams.replay(saves, str(tmp_path), F.col("comes"), 4), ["project"], str(tmp_path), "30 minutes")
    assert Counter(tuple(r) for r in got.collect()) == Counter(tuple(r) for r in memory.anchors(saves, ["project"]).collect())
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider
    (state,) = glob.glob(str(tmp_path / "run-*" / "state"))
    with streams.rocksdb_state(spark):
        assert spark.read.format("statestore").option("path", state).option("stateVarName", "open").load().count() == 0


def test_late_saves_are_left_out(spark, tmp_path):
    saves = spark.createDataFrame([(1, "a", 10**10), (2, "a", 2 * 10**10), (3, "a", 10**9), (4, "a", 3 * 10**10)], "comes long, project string, us long")
    got = streams.run_anchor_stream(streams.replay(saves, str(tmp_path), F.col("comes"), 4), ["project"], str(tmp_path), "1 minute")
    assert sorted(tuple(r) for r in got.collect()) == [("a", 10**10, 1), ("a", 2 * 10**10, 1), ("a", 3 * 10**10, 1)]


def test_lineage_search_by_chance(spark):
    """Against resolving every file first; deletions hide lower branches, and k rows still come."""
    rng = random.Random(6)
    rows = [(f"i{n:03}", [rng.random(), rng.random()], rng.choice(["r", "s"]), rng.choice(["top", "mid", "base", "other"]), f"f{rng.randrange(25)}", rng.random() < 0.5 or None) for n in range(300)]
    points = spark.createDataFrame(rows, "id string, vector array<double>, repo string, branch string, file string, is_deletion boolean")
    query, order = spark.createDataFrame([([0.3, 0.4],)], "q array<double>"), ["top", "mid", "base"]
    first = {}
    for r in rows:
        if r[3] in order:
            first[r[2], r[4]] = min(first.get((r[2], r[4]), 9), order.index(r[3]))
    seen = [((r[1][0] - 0.3) ** 2 + (r[1][1] - 0.4) ** 2, r[0]) for r in rows if r[3] in order and not r[5] and order.index(r[3]) == first[r[2], r[4]]]
    for k in (1, 7, 30, 500):
        got = [r["id"] for r in vector.lineage_nearest(points, query, k, order, widen=2).collect()]
        assert got == [i for _, i in sorted(seen)[:k]]
    assert vector.lineage_nearest(points, query, 5, ["nowhere"]).count() == 0
