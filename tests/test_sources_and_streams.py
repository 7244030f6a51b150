"""Trees, watching, the batched sink, retries and bursts, on small inputs."""

import os
import random
import subprocess
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from graincode.sources import point_sink, tree
from graincode.streaming import operators as streams


def some_tree(root):
    files = {"a.py": b"one", "b/c/d.txt": b"x\xffy", "b/c/e é.txt": "é\n".encode(), "b/f\tg.txt": b"", "z/y/x/w/deep.txt": b"deep", ".hidden": b"h"}
    for path, data in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(data)
    return files


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_tree_source(spark, tmp_path, ranges):
    tree.register(spark)
    files = some_tree(tmp_path)
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "config").write_text("no")
    os.symlink("/", tmp_path / "b" / "loop")
    load = lambda **o: {r["path"]: (r["bytes"], r["content"]) for r in spark.read.format("source_tree").options(ranges=ranges, **o).load(str(tmp_path)).collect()}
    want = {p: (len(d), d.decode(errors="replace")) for p, d in files.items()}
    assert load() == want
    assert load(content="false") == {p: (None, None) for p in files}
    assert ".git/config" in load(skip="b,z") and "b/f\tg.txt" not in load(skip="b,z")


def test_commit_source(spark, tmp_path):
    tree.register(spark)
    files = some_tree(tmp_path)
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", ".")
    git("commit", "-q", "-m", "one")
    (tmp_path / "a.py").write_text("changed")
    for ranges in (1, 4):
        got = spark.read.format("source_tree").options(commit="HEAD", ranges=ranges).load(str(tmp_path)).collect()
        assert {r["path"]: (r["bytes"], r["content"]) for r in got} == {p: (len(d), d.decode(errors="replace")) for p, d in files.items()}
    with pytest.raises(Exception, match="ls-tree"):
        spark.read.format("source_tree").options(commit="nothing").load(str(tmp_path)).collect()


def test_ranges_cover_a_tree_once(tmp_path):
    for i in range(6):
        for j in range(5):
            (tmp_path / f"d{i}" / f"e{j}").mkdir(parents=True)
            (tmp_path / f"d{i}" / f"e{j}" / "f").write_text("x")
            (tmp_path / f"d{i}" / "g").write_text("x")
    own = tree.Folder(str(tmp_path), frozenset())
    for n in (1, 2, 7, 100):
        found = [p for r in tree.path_ranges(own, n) for at, deep in r for p in own.files(at, deep)]
        assert len(found) == len(set(found)) == 36 and len(tree.path_ranges(own, n)) <= n


def test_watch_source(spark, tmp_path):
    """What changes between batches, from where the one before ended, committed or not; a removed file shows as its folder."""
    tree.register(spark)
    root, out = tmp_path / "tree", str(tmp_path / "out")
    some_tree(root)

    def run():
        stream = spark.readStream.format("source_watch").option("ranges", 3).load(str(root))
        q = stream.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/n={n}")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        last = max(int(p.split("=")[1]) for p in os.listdir(out))
        return {(r["path"], r["kind"]) for r in spark.read.parquet(f"{out}/n={last}").collect()}

    assert {p for p, kind in run() if kind == "file"} == {"a.py", "b/c/d.txt", "b/c/e é.txt", "b/f\tg.txt", "z/y/x/w/deep.txt", ".hidden"}
    time.sleep(0.05)
    (root / "a.py").write_text("two")
    (root / "b/c/d.txt").unlink()
    assert run() == {("a.py", "file"), ("b/c", "folder")}


def test_watch_feeds_the_debounce(spark, tmp_path):
    tree.register(spark)
    (tmp_path / "t").mkdir()
    for name in ("x.py", "y.py", ".no"):
        (tmp_path / "t" / name).write_text("x")
    events = spark.readStream.format("source_watch").load(str(tmp_path / "t")).where((F.col("kind") == "file") & streams.watchable(F.col("path"))).withColumn("repo", F.lit("r"))
    seen = []
    bursts = events.withWatermark("ts", "0 seconds").groupBy("repo", F.window("ts", "1 hour")).agg(F.array_sort(F.collect_set("path")).alias("paths"))
    bursts.writeStream.outputMode("update").foreachBatch(lambda df, n: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert [p for r in seen for p in r["paths"]] == ["x.py", "y.py"]


def test_bursts_out_of_order(spark, tmp_path):
    rng = random.Random(1)
    rows = sorted(((t := rng.randrange(40_000)) + rng.randrange(600), rng.choice("ab"), f"f{t % 4}", t) for _ in range(300))
    events = spark.createDataFrame(rows, "comes long, repo string, path string, t long").withColumn("ts", F.timestamp_seconds("t"))
    got = streams.run_debounce_stream(streams.replay(events, str(tmp_path), F.col("comes"), 4), ["repo"], "5 minutes", "10 minutes", str(tmp_path))
    want = streams.debounce(events, ["repo"], "5 minutes")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


# -- the sink


class Broken(point_sink.FolderClient):
    def upsert(self, rows):
        if any(r["id"] == "p7" for r in rows):
            raise OSError("p7 is not welcome")
        super().upsert(rows)


def test_sink_counts_failed_batches(spark, tmp_path, monkeypatch):
    rows = [(f"p{i}", "main" if i < 15 else None if i < 20 else "dev", [1.0] * (2 if i != 25 else 3)) for i in range(40)]
    points = spark.createDataFrame(rows, "id string, branch string, vector array<double>")
    uri, target = f"file://{tmp_path}", f"file://{tmp_path}/store"
    report = point_sink.push_batches(points, uri, {"client": f"{__name__}:Broken", "target": target, "dimension": "2"})
    got = {r["branch"]: tuple(r)[1:5] + (list(r["errors"]),) for r in report.collect()}
    assert got == {"main": (0, 15, 0, 1, ["p7 is not welcome"]), "": (5, 0, 1, 0, []), "dev": (0, 20, 0, 1, ["vector dimension is not 2: p25"])}
    again = point_sink.push_batches(points.where("branch IS NULL"), uri, {"target": target})
    assert again.first()["points"] == 5 and spark.read.parquet(f"{tmp_path}/store").count() == 5  # the same batch again: no second copy
    assert point_sink.push_batches(points.limit(0), uri, {"target": target}).count() == 0


def test_sink_batches_of_a_thousand():
    from pyspark.sql import Row

    sent = []
    writer = point_sink.PointWriter({"client": f"{__name__}:Noted", "by": "branch"})
    Noted.sent = sent
    counts = writer.write(iter([Row(id=str(i), branch="a" if i < 2500 else "b") for i in range(2600)]))
    assert sent == [1000, 1000, 500, 100] and counts.branches == {"a": [2500, 0, 3, 0], "b": [100, 0, 1, 0]}


class Noted:
    sent = None

    def __init__(self, options):
        pass

    def upsert(self, rows):
        self.sent.append(len(rows))


# -- retries


def plain_retries(batches, cap):
    """The log one operation at a time: 'x' fails at its first attempt, 'y' always."""
    up, queue, out = defaultdict(lambda: True), defaultdict(list), {}
    fails = lambda o, attempt: o == "y" or o == "x" and attempt == 0
    for n, rows in enumerate(batches):
        was, fell = dict(up), set()
        for store, seq, healthy, operation in sorted(rows, key=lambda r: r[1]):
            if healthy is not None:
                up[store] = healthy
                fell |= set() if healthy else {store}
            elif up[store] and not fails(operation, 0):
                out[store, seq] = ("direct", n)
            else:
                queue[store].append([seq, operation, int(up[store])])
        for store, waiting in queue.items():
            while len(waiting) > cap:
                out[store, waiting.pop(0)[0]] = ("dropped", n)
            if up[store] and (store in fell or not was.get(store, True)):
                while waiting and not fails(waiting[0][1], waiting[0][2]):
                    out[store, waiting.pop(0)[0]] = ("flushed", n)
                if waiting:
                    waiting[0][2] += 1
    return out | {(s, w[0]): ("waiting", None) for s, q in queue.items() for w in q}


def send(store, seq, operation, attempt):
    if operation == "y" or operation == "x" and attempt == 0:
        raise OSError(operation)


@pytest.mark.parametrize("cap", [10_000, 3])
def test_retries_by_chance(spark, tmp_path, cap):
    rng, rows, seq = random.Random(cap), [], 0
    for _ in range(160):
        seq += 1
        store = rng.choice("ab")
        rows.append((store, seq, rng.random() < 0.5, None) if rng.random() < 0.3 else (store, seq, None, rng.choice("ooooxxy" if store == "a" else "ooox")))
    cuts = [40, 80, 120]
    frame = spark.createDataFrame(rows, "store string, seq long, healthy boolean, operation string")
    got = streams.RetryLog(spark, str(tmp_path), send, cap).run(streams.replay(frame, str(tmp_path), F.col("seq"), 4, cuts))
    want = plain_retries([[r for r in rows if a < r[1] <= b] for a, b in zip([0, *cuts], [*cuts, 999])], cap)
    assert {(r["store"], r["seq"]): (r["state"], r["batch"]) for r in got.collect()} == want
    assert {s for s, _ in want.values()} >= {"direct", "flushed", "waiting"} | ({"dropped"} if cap == 3 else set())


def test_a_batch_that_runs_again(spark, tmp_path):
    log = streams.RetryLog(spark, str(tmp_path), send)
    schema = "store string, seq long, healthy boolean, operation string"
    one = spark.createDataFrame([("a", 1, False, None), ("a", 2, None, "o"), ("a", 3, None, "x"), ("a", 4, None, "o")], schema)
    two = spark.createDataFrame([("a", 5, True, None)], schema)
    log.on_batch(one, 0)
    for _ in range(2):
        log.on_batch(two, 1)
        assert [(r["seq"], r["attempts"]) for r in log._table("waiting", 1, log._QUEUE).orderBy("seq").collect()] == [(3, 1), (4, 0)]
