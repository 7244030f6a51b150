"""Hand fixtures: expectations of small inputs that the tables do not hold."""

import random
import uuid
from collections import Counter

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from graincode.functions import scalars as fn
from graincode.operators import chunking, context, embedding, graph, index_state, indexing, memory, overlay, parsing, sync, vector
from graincode.sources import changes, config, repository, store
from graincode.sources.languages import EXTENSIONS, detect_language
from graincode.streaming import operators as streams


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_ids(spark):
    assert one(spark, fn.deterministic_id(F.lit("repo"), F.lit("main"), F.lit("a.py"), F.lit(10))) == "c1601ecccaccac0df6d66f1f7cf0489a"
    assert one(spark, fn.content_hash(F.lit("hello world"))) == "b94d27b9934d3e08"
    assert one(spark, fn.normalized_hash(F.lit("  Hello\t WORLD \n")))[:24] == "b94d27b9934d3e08a52e52d7"
    assert one(spark, fn.collection_name(F.lit("my-repo"), "x_")) == "x_aa38d26caf184b79"
    assert one(spark, fn.uuid5(F.lit("abc123"))) == str(uuid.uuid5(uuid.UUID(fn.POINT_NAMESPACE), "abc123"))


def test_names(spark):
    assert one(spark, fn.repo_name(F.lit("/a/b/"))) == "b"
    assert one(spark, fn.file_stem(F.lit("x/.env"))) == ".env"
    assert one(spark, fn.file_stem(F.lit("x/a.b.py"))) == "a.b"
    assert one(spark, detect_language(F.lit("a/B.PY"))) == "python"
    assert one(spark, detect_language(F.lit("a/b.bin"))) is None
    assert one(spark, detect_language(F.lit(".py"))) is None
    assert sum(len(e) for e in EXTENSIONS.values()) == 47


@pytest.mark.parametrize(
    "url, host, port",
    [
        ("store.internal", "store.internal", 6334),
        ("store.internal:7001", "store.internal", 7001),
        ("10.1.2.3:80", "10.1.2.3", 80),
        ("grpc-less-host:abc", "grpc-less-host:abc", 6334),
        ("https://vectors.test", "vectors.test", 6334),
        ("http://vectors.test:7002", "vectors.test", 7002),
    ],
)
def test_endpoints(spark, url, host, port):
    h, p = config.parse_endpoint(F.lit(url))
    assert (one(spark, h), one(spark, p)) == (host, port)


def test_name_status(spark):
    lines = ["A\tx.py", "M\ty.py", "D\tz.py", "R100\told.py\tnew.py", "C75\tsrc.py\tcopy.py", "T\tmode.py"]
    got = {tuple(r) for r in changes.parse_name_status(spark.createDataFrame([(x,) for x in lines], "line string")).collect()}
    assert got == {("x.py", "added", None), ("y.py", "modified", None), ("z.py", "deleted", None), ("new.py", "renamed", "old.py"), ("copy.py", "added", None)}


def test_read_lines(spark):
    f = spark.createDataFrame([("a\nb\nc",)], "content string")
    assert changes.read_lines(f, 2, 9).first()["excerpt"] == "b\nc"
    assert changes.read_lines(f, 0, 1).first()["excerpt"] == "a\nb\nc"
    assert changes.read_lines(f, 4, 5).first()["error"] is not None


EDGE = "source string, target string, kind string, source_file string, target_file string, line int, repo string, branch string, ord long"


def test_graph(spark):
    rows = [
        ("a.py::main", "b.py::helper", "calls", "a.py", "b.py", 10, "/repo/", "main", 1),
        ("a.py::main", "b.py::helper", "calls", "a.py", "b.py", 12, "/repo", "main", 2),
        ("a.py::main", "os", "imports", "a.py", "os.py", 1, "/repo", "main", 3),
        ("a.py::main", "sys", "imports", "a.py", "sys.py", 2, "/repo", "main", 4),
    ]
    e = graph.upsert(None, spark.createDataFrame(rows, EDGE))
    assert [r["line"] for r in graph.callers(e, "b.py::helper").collect()] == [12]
    assert graph.dependencies(e, "a.py").count() == 2
    assert graph.callees(graph.remove_file(e, "a.py"), "a.py::main").count() == 0
    assert {r["source_file"] for r in graph.rename_file(e, "a.py", "renamed.py").collect()} == {"renamed.py"}


def test_overlay(spark):
    rows = spark.createDataFrame([("a", "main", 1), ("a", "feature", 2), ("b", "main", 3), ("c", "other", 4), ("c", "main", 5)], "file string, branch string, pos int")
    got = [(r["file"], r["branch"]) for r in overlay.overlay(rows, ["feature", "main"]).orderBy("pos").collect()]
    assert got == [("a", "feature"), ("b", "main"), ("c", "main")]


SAVE = "project string, scope string, us long, event_id long, hash string, topic_key string"


def test_memory_saves(spark):
    s = [("p", "s", t * 1_000_000, i, "h", None) for i, t in enumerate((0, 100, 899, 900, 1700, 1801))]
    rows = {(r["created"] // 1_000_000, r["duplicates"]) for r in memory.save_fold(spark.createDataFrame(s, SAVE)).collect()}
    assert rows == {(0, 2), (900, 1), (1801, 0)}
    got = {(r["anchor"] // 1_000_000, r["n"]) for r in memory.anchors(spark.createDataFrame(s, SAVE), ["project"]).collect()}
    assert got == {(0, 3), (900, 2), (1801, 1)}
    topic = [("p", "s", 0, 1, "a", "t"), ("p", "s", 5000 * 10**6, 2, "b", "t")]
    assert [(r["revision"], r["hash"]) for r in memory.save_fold(spark.createDataFrame(topic, SAVE)).collect()] == [(2, "b")]
    late = [("p", "s", 0, 1, "a", None), ("p", "s", 10**6, 2, "a", "t"), ("q", "s", 10**6, 3, "a", None)]
    got = {(r["project"], r["duplicates"], r["topic_key"]) for r in memory.save_fold(spark.createDataFrame(late, SAVE)).collect()}
    assert got == {("p", 1, None), ("q", 0, None)}


def plain_saves(rows, gap):
    """A model of the three-way save, by scanning all rows."""
    out = []
    for project, scope, us, event, h, topic in sorted(rows, key=lambda r: (r[2], r[3])):
        live = [r for r in out if (r["project"], r["scope"]) == (project, scope)]
        same = [r for r in live if topic and r["topic_key"] == topic]
        near = [r for r in live if r["hash"] == h and r["created"] > us - gap]
        if same:
            same[0].update(hash=h, revision=same[0]["revision"] + 1)
        elif near:
            near = max(near, key=lambda r: (r["created"], r["n"]))
            near["duplicates"] += 1
        else:
            out.append({"project": project, "scope": scope, "topic_key": topic, "hash": h, "created": us, "revision": 1, "duplicates": 0, "n": len(out)})
    return sorted((r["project"], r["created"], r["hash"], r["topic_key"] or "", r["revision"], r["duplicates"]) for r in out)


def test_memory_saves_by_chance(spark):
    rng = random.Random(5)
    rows = [(rng.choice("pq"), "s", rng.randrange(10_000) * 10**6, i, rng.choice("abc"), rng.choice([None, None, "t", "u"])) for i in range(400)]
    got = memory.save_fold(spark.createDataFrame(rows, SAVE)).collect()
    assert sorted((r["project"], r["created"], r["hash"], r["topic_key"] or "", r["revision"], r["duplicates"]) for r in got) == plain_saves(rows, 900 * 10**6)


def test_debounce_stream(spark, tmp_path):
    rows = [(t, "r", f"f{t}") for t in (0, 3, 6, 20, 22, 60)]
    spark.createDataFrame(rows, "t long, repo string, path string").select(F.timestamp_seconds("t").alias("ts"), "repo", "path").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, repo string, path string").parquet(str(tmp_path / "in"))
    q = streams.debounce_stream(stream, ["repo"], "5 seconds", "0 seconds").writeStream.outputMode("append").format("memory").queryName("bursts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r["paths"]) for r in spark.table("bursts").collect()}
    assert {("f0", "f3", "f6"), ("f20", "f22")} <= got


def test_queue(spark):
    log = spark.createDataFrame([("s", i, False) for i in range(1, 6)], "store string, seq int, fails boolean")
    assert sorted(r["seq"] for r in streams.bounded_queue(log, ["store"], cap=3).collect()) == [3, 4, 5]
    three = spark.createDataFrame([("s", 1, False), ("s", 2, True), ("s", 3, False)], "store string, seq int, fails boolean")
    assert [r["state"] for r in streams.flush(three, ["store"]).orderBy("seq").collect()] == ["done", "waiting", "waiting"]


POINT = "id string, repo string, branch string, content_hash string, indexed_at string"


@pytest.mark.parametrize(
    "local, shared, want",
    [
        ([("p1", "r", "m", "a", "1")], [("p2", "r", "m", "b", "1")], (1, 1, 0)),
        ([("p1", "r", "m", "a", "1")], [("p1", "r", "m", "b", "2")], (0, 1, 1)),
        ([("p1", "r", "m", "a", "2")], [("p1", "r", "m", "b", "1")], (1, 0, 1)),
        ([("p1", "r", "m", "a", "1")], [("p1", "r", "m", "a", "2")], (0, 0, 0)),
        ([], [], (0, 0, 0)),
    ],
)
def test_sync(spark, local, shared, want):
    left, right = (spark.createDataFrame(x, POINT) for x in (local, shared))
    assert tuple(sync.summary(sync.plan(left, right)).first()) == want
    a, b = sync.apply(left, right)
    ids = {r[0] for r in (*local, *shared)}
    assert {r["id"] for r in a.collect()} == {r["id"] for r in b.collect()} == ids


def test_packing(spark):
    rows = spark.createDataFrame([(1, i, c) for i, c in enumerate((40, 50, 30, 5))], "g int, o int, c long")
    assert [r["c"] for r in context.pack_prefix(rows, ["g"], ["o"], "c", 100).orderBy("o").collect()] == [40, 50]
    assert [r["c"] for r in context.pack_greedy(rows, ["g"], "o", "c", 100).orderBy("o").collect()] == [40, 50, 5]


def plain_context(memories, hits, found, budget):
    """The reference's loops; found gives the chunks of a hint."""
    out, used, hints = [], 0, []
    cost = lambda note: len(note.encode()) // 4
    for _, score, text in memories:
        if text and score < 1.5:
            note = f"// [memory] {text}\n\n"
            if used + cost(note) <= budget:
                out.append(note)
                used += cost(note)
            for w in text.split():
                w = w.strip(context.HINT_TRIM)
                hints += [w] * (w.endswith(context.HINT_SUFFIXES) + ("/" in w and len(w.encode()) > 3))
    for file, line, text in (c for h in hints for c in found(h)):
        note = f"// {file}:{line}\n{text}\n\n"
        if used + cost(note) <= budget:
            out.append(note)
            used += cost(note)
    there = "".join(out)
    for _, file, line, text in hits:
        note = f"// {file}:{line}\n{text}\n\n"
        if f"// {file}:" in there:
            continue
        if used + cost(note) > budget:
            break
        out.append(note)
        used += cost(note)
    return out


@pytest.mark.parametrize("budget", [4096, 150, 90, 40])
def test_build_context_hints(spark, budget):
    memories = [(1, 0.1, "see src/a.ts, and (b.service)."), (2, 0.2, ""), (3, 0.3, "x" * 300 + " c/d"), (4, 1.6, "far.js"), (5, 0.4, "known // m.md: é b.service")]
    places = {"src/a.ts": 0.0, "b.service": 10.0, "c/d": 20.0}
    points = [(f"p{i:02}", [float(i)], f"f{i % 7}.md", i % 3, "t" * (5 + 40 * (i % 4))) for i in range(25)]
    hits = [(i + 1, *points[i][2:]) for i in (3, 0, 4, 10, 5, 6)]
    hits = [(k + 1, *h[1:]) for k, h in enumerate([*hits, (0, "m.md", 1, "t"), (0, "n.md", 1, "é" * 9)])]

    def found(hint):
        three = sorted(points, key=lambda p: ((p[1][0] - places[hint]) ** 2, p[0]))[:3]
        return [c for i, c in enumerate(p[2:] for p in three) if c[:2] not in [x[2:4] for x in three[:i]]]

    embed = lambda hints: hints.withColumn("q", F.array(F.create_map(*[F.lit(x) for kv in places.items() for x in kv])[F.col("hint")]))
    m = spark.createDataFrame(memories, "pos int, score double, text string")
    hinted = context.hint_hits(m, spark.createDataFrame(points, "id string, vector array<double>, file string, start_line int, text string"), embed)
    got = context.build_context(m, spark.createDataFrame(hits, "pos int, file string, start_line int, text string"), budget, hinted=hinted).collect()
    got.sort(key=lambda r: (["memory", "hint", "code"].index(r["part"]), r["pos"]))
    assert [r["note"] for r in got] == plain_context(memories, hits, found, budget)


def test_lineage_of_long_chains_and_cycles(spark):
    parent = {f"b{i}": f"b{i + 1}" for i in range(150)} | {"c0": "c1", "c1": "c2", "c2": "c0", "in": "c1", "own": "own", "root": None, "last": "gone"}
    want = []
    for b in parent:
        chain = [b]
        while (up := parent.get(chain[-1])) is not None and up not in chain:
            chain.append(up)
        want += [(b, a, k) for k, a in enumerate(chain)]
    base = spark.createDataFrame(list(parent.items()), "branch string, base_branch string")
    assert sorted(tuple(r) for r in index_state.lineage(base).collect()) == sorted(want)
    assert sorted(tuple(r) for r in index_state.lineage(base, "b0").collect()) == sorted(w for w in want if w[0] == "b0")


SYMBOL = "file string, ord int, name string, kind string, parent string, signature string, docstring string, code string, start_line int, end_line int"


def split_at(code, start=1):
    lines = [f"    x = {i}  # padding padding padding padding padding padding" for i in range(99)]
    lines = ["def f():", *lines]
    for i in code:
        lines[i] = ""
    return "\n".join(lines), start


@pytest.mark.parametrize(
    "blank, want",
    [((22, 50, 73), [(10, 60), (61, 109)]), ((22, 47, 73), [(10, 57), (58, 107), (108, 109)]), ((22, 53, 73), [(10, 63), (64, 109)])],
)
def test_split_large(spark, blank, want):
    code, _ = split_at(blank)
    df = spark.createDataFrame([("f.py", 0, "f", "function", None, "function f", None, code, 10, 109)], SYMBOL)
    assert sorted((r["start_line"], r["end_line"]) for r in chunking.split_large(df).collect()) == want


def plain_split(lines, target):
    out, start = [], 0
    while start < len(lines):
        end = min(start + target, len(lines))
        if end < len(lines):
            for off in range(min(5, target // 3)):
                if end + off < len(lines) and not lines[end + off].strip():
                    end = end + off + 1
                    break
                if end - off > start and not lines[end - off].strip():
                    end = end - off + 1
                    break
        out.append((start + 1, end))
        start = end
    return out


def test_split_by_chance(spark):
    rng, rows, want = random.Random(1), [], {}
    for k in range(12):
        lines = ["def g():"] + [rng.choice(["", "  ", "x" * 60, "y = 1", "z" * 30]) for _ in range(rng.randrange(20, 300))]
        code = "\n".join(lines)
        rows.append((f"f{k}", 0, "g", "function", None, "function g", None, code, 1, len(lines)))
        want[f"f{k}"] = plain_split(lines, max(10, len(lines) // max(1, len(code) // 4 // 512)))
    got = {}
    for r in chunking.split_large(spark.createDataFrame(rows, SYMBOL)).collect():
        got.setdefault(r["file"], []).append((r["start_line"], r["end_line"]))
    assert {k: sorted(v) for k, v in got.items()} == want


def test_python_parser_and_errors(spark):
    files = spark.createDataFrame(
        [("a.py", "python", "import os\nclass A:\n    def m(self): return os.getcwd()\n"), ("b.py", "python", "def ("), ("c.md", "markdown", "text"), ("d.md", "markdown", " \n"), ("e.py", "python", None)],
        "file string, language string, content string",
    )
    got = {r["file"]: r for r in parsing.parse(files).collect()}
    assert [(s["name"], s["kind"], s["parent"]) for s in got["a.py"]["symbols"]] == [("A", "class", None), ("m", "method", "A")]
    assert got["b.py"]["error"].startswith("SyntaxError") and got["c.md"]["symbols"][0]["name"] == "c"
    assert got["d.md"]["symbols"] == [] and got["e.py"]["symbols"] == [] and got["e.py"]["error"] is None


KINDS = "id string, repo string, branch string, file string, start_line int, vector array<float>, symbol string"


def points(spark, *rows):
    return spark.createDataFrame([(i, r, b, f, 1, [1.0, 0.0], s) for i, r, b, f, s in rows], KINDS)


def test_store(spark, tmp_path):
    t = store.VersionedTable(spark, str(tmp_path / "t"))
    assert t.read() is None and t.count() == 0
    t.upsert(points(spark, ("1", "r", "b", "f", None), ("3", "r2", "b", "f", "x")))
    first, other = t.read(), dict(t._manifest()[1])
    t.upsert(points(spark, ("1", "r", "b", "f", "s"), ("2", "r", "b", "g", None)))
    assert sorted((r["id"], r["symbol"]) for r in t.read().collect()) == [("1", "s"), ("2", ""), ("3", "x")]
    assert sorted((r["id"], r["symbol"]) for r in first.collect()) == [("1", ""), ("3", "x")]  # readers keep what they read
    assert len(set(other.values()) & set(t._manifest()[1].values())) == 1  # only the touched bucket was written
    gone = spark.createDataFrame([("r", "b", "f"), ("r2", "b", "f")], "repo string, branch string, file string")
    t.rename_files(spark.createDataFrame([("r", "b", "g", "h")], "repo string, branch string, file string, new_file string"))
    t.delete_files(gone)
    assert [(r["file"], r["symbol"]) for r in t.read().collect()] == [("h", "")] and t.count() == 1
    assert t.vacuum() > 0 and t.count() == 1
    assert [(r["original_id"], r["id"]) for r in store.to_shared(points(spark, ("1", "r", "b", "f", None))).collect()] == [("1", str(uuid.uuid5(uuid.UUID(fn.POINT_NAMESPACE), "1")))]
    with pytest.raises(Exception, match="dimension"):
        store.require_dimension(points(spark, ("1", "r", "b", "f", None)), 3).collect()
    t.drop()
    assert t.read() is None


def test_two_writers(spark, tmp_path, monkeypatch):
    one, two = (store.VersionedTable(spark, str(tmp_path / "t")) for _ in range(2))
    one.upsert(points(spark, ("1", "r", "b", "f", "a")))
    stale = two._manifest()
    one.upsert(points(spark, ("2", "r", "b", "f", "b")))
    monkeypatch.setattr(two, "_manifest", lambda: stale)
    with pytest.raises(store.WriteConflict):
        two.upsert(points(spark, ("3", "r", "b", "f", "c")))
    assert sorted(r["id"] for r in one.read().collect()) == ["1", "2"]


def test_died_writers(spark, tmp_path):
    """A writer that dies before or while it writes its manifest leaves the version before, also for the next writers."""
    t = store.VersionedTable(spark, str(tmp_path / "t"), buckets=4)
    t.upsert(points(spark, ("1", "r", "b", "f", "a")))
    (tmp_path / "t" / "manifests" / "000000000002.json").write_text("")
    (tmp_path / "t" / "manifests" / "000000000003.json").write_text('{"0": "half')
    (tmp_path / "t" / "manifests" / "_left").write_text("x")
    assert t.count() == 1
    t.upsert(points(spark, ("2", "r", "b", "f", "b")))
    assert sorted(r["id"] for r in t.read().collect()) == ["1", "2"] and t._manifest()[0] == 4


def test_hybrid_store_does_not_queue_what_is_wrong(spark, tmp_path):
    both = store.open_store(spark, config.Settings("hybrid", str(tmp_path / "l"), str(tmp_path / "s")))
    both.upsert(points(spark, ("1", "r", "b", "f", "a")))
    with pytest.raises(AnalysisException):
        both.shared.upsert(spark.range(1))
    with pytest.raises(AnalysisException):
        both.upsert(points(spark, ("2", "r", "b", "f", "a")).drop("repo"))
    assert not both.log


def test_real_repository(spark, tmp_path):
    """Paths that are not ASCII, folders that are not tracked, names with spaces, tabs and arrows."""
    import subprocess

    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    git("init", "-q")
    names = ["é.py", "a b.py", "t\tab.py", "old name.py", "x -> y.py"]
    for n in names:
        (tmp_path / n).write_text(n * 20)
    git("add", ".")
    git("commit", "-q", "-m", "one")
    r = repository.Repository(str(tmp_path))
    assert {x["path"] for x in r.changes(spark, None).collect()} == set(names) and r.state().dirty == ()
    git("mv", "old name.py", "new name.py")
    (tmp_path / "é.py").write_text("changed")
    (tmp_path / "new" / "deep").mkdir(parents=True)
    (tmp_path / "new" / "deep" / "f é.py").write_text("x")
    assert set(r.state().dirty) == {"new name.py", "é.py", "new/deep/f é.py"}
    assert {tuple(x) for x in r.uncommitted(spark).collect()} == {("new name.py", "renamed", "old name.py"), ("é.py", "modified", None), ("new/deep/f é.py", "added", None)}
    git("add", ".")
    git("commit", "-q", "-m", "two")
    assert {tuple(x)[:2] for x in r.changes(spark, "HEAD~1").collect()} == {("new name.py", "renamed"), ("é.py", "modified"), ("new/deep/f é.py", "added")}
    assert r.content("é.py", "HEAD~1") == "é.py" * 20
    assert {x["path"]: x["content"] for x in r.files(spark, "HEAD~1").collect()} == {n: n * 20 for n in names}
    assert {x["path"]: x["content"] for x in r.files(spark).collect()}["é.py"] == "changed"


def test_hybrid_store_waits_and_flushes(spark, tmp_path, monkeypatch):
    own = config.Settings("hybrid", str(tmp_path / "l"), str(tmp_path / "s"))
    both = store.open_store(spark, own)
    assert isinstance(both, store.HybridTable) and isinstance(store.open_store(spark, config.Settings("local", "x")), store.VersionedTable)
    both.upsert(points(spark, ("1", "r", "b", "f", "a")))
    up, down = both.shared.upsert, lambda batch: (_ for _ in ()).throw(OSError("down"))
    monkeypatch.setattr(both.shared, "upsert", down)
    both.upsert(points(spark, ("2", "r", "b", "g", "b")))
    both.delete_files(spark.createDataFrame([("r", "b", "f")], "repo string, branch string, file string"))
    assert [x[0] for x in both.log] == ["upsert"] and both.flush() == 0 and both.read().count() == 1
    monkeypatch.setattr(both.shared, "upsert", up)
    assert both.flush() == 1 and not both.log and [r["id"] for r in both.shared.read().collect()] == ["2"]


def test_settings(tmp_path):
    text = "# settings\nstate_dir: /s  # here\nstorage:\n  mode: Shared\n  shared_url: 'h:1'\nindexing:\n  exclude:\n    - \"a/**\"\n    - b\n  n: 3\nflags: [true, x]\n"
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "own.yaml").write_text(text)
    found = config.find_config(str(tmp_path / "a" / "b"), ("own.yaml",))
    assert found == (tmp_path / "a" / "own.yaml").resolve() and config.find_config(str(tmp_path), ("none.yaml",)) is None
    file = config.load_config(found)
    assert file == {"state_dir": "/s", "storage": {"mode": "Shared", "shared_url": "h:1"}, "indexing": {"exclude": ["a/**", "b"], "n": 3}, "flags": [True, "x"]}
    assert config.settings({"GRAINCODE_TOKEN": "t"}, file) == config.Settings("shared", "/s/vectors", "h:1", "t", ("a/**", "b"))
    assert config.settings({"GRAINCODE_MODE": "LOCAL", "GRAINCODE_LOCAL_PATH": ""}, file).local_path == "/s/vectors"
    assert config.settings({}, None, home="/h") == config.Settings("local", "/h/.local/share/graincode/vectors")
    for env, what in (({"GRAINCODE_MODE": "shared"}, "shared_url"), ({"GRAINCODE_MODE": "shared", "GRAINCODE_SHARED_URL": "h"}, "token"), ({"GRAINCODE_MODE": "cloud"}, "unknown mode")):
        with pytest.raises(ValueError, match=what):
            config.settings(env)
    assert config.parse_yaml("") == {} and config.parse_yaml("a:\n- 1\n- 2\nb: c") == {"a": [1, 2], "b": "c"}
    with pytest.raises(ValueError):
        config.parse_yaml("a: 1\n   nonsense")


def test_repository(spark, tmp_path):
    said = {"rev-parse --abbrev-ref HEAD": "topic\n", "rev-parse HEAD": "c1\n", "status --porcelain -z -u": " M a.py\0?? n.txt\0R  y\0x\0", "rev-parse --verify main": "c0\n", "merge-base topic main": "c0\n",
            "diff --name-status -z -M c0 HEAD": "M\0a.py\0R100\0x\0y\0", "diff --name-status -z -M HEAD": "D\0b.py\0", "ls-files -z --others --exclude-standard": "n.txt\0", "show c1:a.py": "text"}

    def run(*args):
        if " ".join(args) not in said:
            raise RuntimeError("no such thing")
        return said[" ".join(args)]

    r = repository.Repository("/x", run)
    assert r.state() == repository.State("c1", "topic", False, ("a.py", "n.txt", "y"))
    rows = lambda df: {tuple(x) for x in df.collect()}
    assert rows(r.changes(spark, "c0")) == {("a.py", "modified", None), ("y", "renamed", "x")}
    assert rows(r.uncommitted(spark)) == {("b.py", "deleted", None), ("n.txt", "added", None)}
    assert r.content("a.py", "c1") == "text" and r.content("z", "c1") is None
    assert r.lineage() == [("topic", 0), ("main", 1)]
    said |= {"rev-parse --abbrev-ref HEAD": "HEAD\n", "rev-parse --short HEAD": "c1\n"}
    assert r.lineage() == [("c1", 0)] and r.state().detached
    with pytest.raises(RuntimeError):
        repository.Repository(str(tmp_path)).state()
    assert "--incremental" in repository.post_commit_hook("index")
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "f.txt").write_bytes(b"a\xffb")
    assert [r["content"] for r in changes.read_tree(spark, str(tmp_path)).collect()] == ["a\ufffdb"]


def test_providers(spark, tmp_path):
    sent = []

    def post(url, body, headers):
        sent.append((url, len(body.get("texts", body.get("input"))), headers, body.get("input_type")))
        n = len(body.get("texts", body.get("input")))
        return {"vectors": [[3.0, 4.0]] * n} if "texts" in body else {"data": [{"index": i, "embedding": [float(i), 0.0]} for i in reversed(range(n))]}

    custom = embedding.create_provider({"provider": "custom", "endpoint": "http://h/", "dimension": 3, "token": "t"})
    custom.post = post
    with pytest.warns(UserWarning, match="2 dimensions"):
        assert custom.embed(["a", "b"]) == [[3.0, 4.0]] * 2 and custom.embed_single("a") == [3.0, 4.0] and custom.embed([]) == []
    assert sent[0] == ("http://h/embed", 2, {"Authorization": "Bearer t"}, None)
    hosted = embedding.create_provider({"provider": "hosted_documents", "endpoint": "http://e", "dimension": 2, "model": "m"})
    hosted.post = post
    assert [v[0] for v in hosted.embed(["x"] * 130)] == [*map(float, range(128)), 0.0, 1.0] and [s[1] for s in sent[-2:]] == [128, 2] and sent[-1][3] == "document"
    with pytest.raises(ValueError, match="unknown provider"):
        embedding.create_provider({"provider": "none"})
    embedding.register("two", lambda c: hosted)
    assert embedding.create_provider({"provider": "two"}) is hosted
    made = spark.createDataFrame([("b c",), (None,)], "text string").select(embedding.embed_with(embedding.HashProvider, F.col("text")).alias("v")).collect()
    assert abs(sum(x * x for x in made[0]["v"]) - 1) < 1e-6 and not any(made[1]["v"])
    assert not embedding.is_cached("a/b", str(tmp_path))
    (tmp_path / "models--a--b" / "snapshots" / "s").mkdir(parents=True)
    assert embedding.is_cached("a/b", str(tmp_path))


def test_active_context(spark):
    now = index_state.ActiveContext().switch("r", "b").switch(branch="c")
    assert (now.repo, now.branch) == ("r", "c") and (now.switch("s").repo, now.branch) == ("s", "c")


def test_active_context_of_symbols(spark):
    rows = [("1", "a", "main", "src/n5.py", "f", "function", [0.0]), ("2", "a", "dev", "src/n6.py", "f", "function", [0.1]), ("3", "b", "main", "src/n7.py", "f", "function", [0.2])]
    points = spark.createDataFrame(rows, "id string, repo string, branch string, file string, symbol string, symbol_type string, vector array<double>")
    edges = spark.createDataFrame([("x::f", "y", "calls", r, b, f"{r}{b}", k, k) for k, (r, b) in enumerate([("/p/a", "main"), ("/p/a", "dev"), ("/p/b", "main")])] + [("z", "./n6", "imports", "/p/a", "dev", "w", 9, 9)],
                                  "source string, target string, kind string, repo string, branch string, source_file string, line int, ord int")
    query, own = spark.createDataFrame([([0.0],)], "q array<double>"), index_state.ActiveContext("a", "dev")
    assert own.read_symbol(points, query, "F").first()["id"] == "2" and own.read_symbol(points, query, "f", "b", "main").first()["id"] == "3"
    seen = lambda df: {r["source_file"] for r in df.collect()}
    assert seen(own.references(edges, points.where("branch = 'dev'"), query, "f")) == {"/p/adev", "w"}
    assert seen(own.references(edges, points, query, "f", "/p/b/", "main")) == {"/p/bmain"}
    assert seen(index_state.ActiveContext().references(edges, points, query, "f")) == {"/p/amain", "/p/adev", "/p/bmain"}


def test_adjacency(spark, tmp_path):
    """The rows of the rounds over all edges, with edges between nodes of a frontier, loops and repeated edges, from the frontier's buckets alone."""
    rng = random.Random(3)
    rows = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}", i) for i in range(60)] + [("n1", "n1", 99), ("n1", "n2", 98), ("n1", "n2", 98)]
    edges = spark.createDataFrame(rows, "source string, target string, line int")
    own = graph.Adjacency(spark, str(tmp_path / "adj"), buckets=8)
    own.write(edges)
    plain, seen, front = Counter(), {"n1"}, {"n1"}
    for step in (1, 2, 3):
        met = [r for r in rows if r[0] in front or r[1] in front]
        plain.update((*r, step) for r in met)
        front = {x for r in met for x in r[:2]} - seen
        seen |= front
    for found in (own.subgraph("n1", 3), graph.subgraph(edges, "n1", 3)):
        assert Counter(tuple(r) for r in found.collect()) == plain
    assert own.subgraph("nothing", 2).count() == graph.subgraph(edges, "nothing", 2).count() == 0
    one = own.touching(spark.createDataFrame([("n1",)], "node string"))
    assert "PartitionFilters: [" in one._jdf.queryExecution().toString() and "bucket" in one._jdf.queryExecution().toString().split("PartitionFilters: [")[1].split("]")[0]


def test_sessions(spark):
    kinds = "owner long, session string, started long, ended long"
    had = spark.createDataFrame([(1, "a", 1, None), (1, "b", 0, 1), (2, "c", 1, None)], kinds)
    got = index_state.start_session(had, spark.createDataFrame([(1, "d", 5, None)], kinds), ["owner"])
    assert {(r["session"], r["ended"]) for r in got.collect()} == {("a", 5), ("b", 1), ("c", None), ("d", None)}
    assert {(r["session"], r["ended"]) for r in index_state.end_session(got, "d", 9).collect()} >= {("d", 9), ("a", 5)}


def test_dates(spark):
    t = F.lit("2025-03-04T05:06:07.000089Z").try_cast("timestamp")
    assert one(spark, fn.iso_utc(t)) == "2025-03-04T05:06:07.000089+00:00"
    assert one(spark, F.unix_micros(fn.from_iso(F.lit("2025-03-04T06:06:07+01:00")))) == one(spark, F.unix_micros(t)) - 89
    assert one(spark, fn.from_iso(F.lit("no date"))) is None


def test_index_modes(spark):
    last = spark.createDataFrame([("m",)], "model string")
    assert [indexing.run_mode(x, m, i) for x, m, i in ((last.limit(0), "m", True), (last, "m", True), (last, "n", True), (last, "m", False))] == ["full", "incremental", "full", "full"]
    kinds = "file string, language string, symbol_count int, content_hash string"
    files = spark.createDataFrame([("a.py", "python", "def a(): pass"), ("new.py", "python", "def n(): pass"), ("bad.py", "python", "def (")], "file string, language string, content string")
    same = files.where("file = 'a.py'").select(fn.content_hash(F.col("content"))).first()[0]
    records = spark.createDataFrame([("a.py", "python", 1, same), ("old.py", "python", 5, "h"), ("gone.py", "python", 7, "h"), ("bad.py", "python", 2, "h")], kinds)
    moves = spark.createDataFrame([("new.py", "renamed", "old.py"), ("gone.py", "deleted", None), ("a.py", "modified", None), ("bad.py", "modified", None)], "path string, status string, old_path string")
    run = indexing.index_repo(files, records, last, "m", moves)
    t = run["totals"].first()
    assert (run["mode"], t["file_count"], t["symbol_count"], t["total_files"], t["total_symbols"], t["deleted_files"]) == ("incremental", 1, 1, 2, 2, 1)
    assert {r["file"] for r in run["removed"].collect()} == {"gone.py", "new.py", "bad.py"} and {tuple(r) for r in run["moved"].collect()} == {("old.py", "new.py")}
    assert {r["file"] for r in run["errors"].collect()} == {"bad.py"} and {r["file"] for r in run["records"].collect()} == {"a.py", "new.py"}


def test_batch_search_of_nothing(spark):
    none = spark.createDataFrame([], "id string, vector array<float>")
    q = spark.createDataFrame([(1, [1.0])], "query_id long, vector array<float>")
    assert vector.batch_top_k(none, q, 3).count() == 0


NEAR = "id string, vector array<float>"


def test_top_k_ranks_by_the_exact_score(spark):
    points, q = spark.createDataFrame([("a", [0.0102]), ("b", [0.0101])], NEAR), spark.createDataFrame([([0.01],)], "q array<float>")
    assert [(r["id"], r["score"]) for r in vector.top_k(points, q, 1).collect()] == [("b", 0.0)]
    assert [r["id"] for r in vector.top_k(spark.createDataFrame([("z", [1.0]), ("y", [1.0])], NEAR), q, 1).collect()] == ["y"]


@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_batch_search_breaks_ties_by_id(spark, monkeypatch, limit):
    monkeypatch.setattr(vector, "BROADCAST_BYTES", limit)
    rng = random.Random(2)
    equal = [rng.random() for _ in range(24)]
    rows = [(f"p{i}", equal) for i in range(40, 100)] + [(f"a{i}", [rng.random() - 0.9 for _ in range(24)]) for i in range(50)] + [("zero", [0.0] * 24)]
    queries = spark.createDataFrame([(1, equal), (2, [0.0] * 24)], "query_id long, vector array<float>")
    got = vector.batch_top_k(spark.createDataFrame(rows, NEAR), queries, 3, slab=20).collect()
    assert sorted(r["id"] for r in got if r["query_id"] == 1) == ["p40", "p41", "p42"]
    assert sorted(r["id"] for r in got if r["query_id"] == 2) == ["a0", "a1", "a10"]


def test_anchors_by_chance(spark):
    rng, rows, want = random.Random(4), [], Counter()
    for key in ("a", "b", None):
        times = sorted(rng.randrange(0, 40_000) * 1_000_000 for _ in range(300))
        anchor = None
        for t in times:
            if anchor is None or t - anchor >= 900_000_000:
                anchor = t
            want[key, anchor] += 1
        rows += [(key, t) for t in times]
    rng.shuffle(rows)
    got = memory.anchors(spark.createDataFrame(rows, "k string, us long"), ["k"]).collect()
    assert Counter({(r["k"], r["anchor"]): r["n"] for r in got}) == want


def test_greedy_packing_by_chance(spark):
    rng, rows, want = random.Random(7), [], set()
    for key in ("a", "b"):
        used = 0
        for o in range(200):
            c = rng.choice([0, 1, 5, 30, 70, 101])
            rows.append((key, o, c))
            if used + c <= 100:
                used += c
                want.add((key, o, c))
    got = context.pack_greedy(spark.createDataFrame(rows, "g string, o int, c long"), ["g"], "o", "c", 100).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
