"""Plans that must not fall to one task, one worker or one driver as tables grow."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from graincode.operators import embedding, graph, indexing, parsing, vector
from graincode.plans import queries_more, queries_scan, queries_state
from graincode.sources import store

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("sources", [queries_scan._sources, queries_more._more, queries_state._sources])
def test_sources_are_dealt_to_tasks(spark, sources):
    """part is one small file: what is made of it is parsed by all cores."""
    assert sources(spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_fallback_is_parsed_once(spark):
    df = entry.queries()["parse_fallback"](spark, SF)
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and plan_of(df).count("MapInArrow") == 1


@pytest.mark.parametrize("language", list(queries_scan.SOURCES))
def test_parts_are_those_of_the_whole(language):
    source = queries_scan.SOURCES[language].replace("%d", "1")
    whole = parsing._one("f", language, source, frozenset())
    for k, part in enumerate(parsing.PARTS):
        assert parsing._one("f", language, source, frozenset(), (part,))[k] == whole[k]


def test_columns_asked_for(spark):
    files = spark.createDataFrame([("a.py", "python", "import os\n", 1), ("b.go", "go", None, 2), ("c.py", "python", "def (", 3)], "file string, language string, content string, n long")
    got = parsing.parse(files, parts=("imports",), more=("n",)).orderBy("n")
    assert got.columns == ["file", "language", "imports", "error", "n"]
    assert [(r["n"], [i["module"] for i in r["imports"]], r["error"] is None) for r in got.collect()] == [(1, ["os"], True), (2, [], True), (3, [], False)]


def test_an_index_run_parses_once(spark):
    """Chunks, records and counts read what was written, and do not parse again."""
    done = indexing.index(queries_state._sources(spark, SF))
    assert "MapInArrow" not in plan_of(indexing.summary(done["chunks"], done["records"])) and "MapInArrow" not in plan_of(done["edges"])
    assert "MapInArrow" in plan_of(indexing.index(queries_state._sources(spark, SF), keep=False)["errors"])


def test_joins_that_grow_stay_off_the_driver(spark):
    """Sides that grow with the input are merged, however small they look: none is broadcast."""
    files = queries_state._sources(spark, SF)
    done = indexing.index(files)
    one = spark.createDataFrame([("r", "b", "f", "g", 1, "i")], "repo string, branch string, file string, new_file string, start_line int, id string")
    known = files.select("file", "language", F.lit(1).alias("symbol_count"), F.lit("x").alias("content_hash"))
    changes = files.select(F.col("file").alias("path"), F.lit("renamed").alias("status"), F.col("file").alias("old_path"))
    made = [done["chunks"], indexing.apply_changes(known, changes), indexing.needs_work(files, known), store.rename_files(one.drop("new_file"), one), store.delete_files(one, one), store.upsert(one, one)]
    for df in made:
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_hash_embed_by_row(spark):
    """The vectors of the provider, without a shuffle; null, empty and wordless texts are zeros."""
    texts = ["a b a", "Ä-x K1\n", "", None, "...", "w " * 3000]
    df = embedding.hash_embed(spark.createDataFrame(list(enumerate(texts)), "n long, t string"), ["n"], "t")
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    own = embedding.HashProvider(64)
    assert {r["n"]: r["vector"] for r in df.collect()} == {i: own.embed_single(t or "") for i, t in enumerate(texts)}


def test_batch_search_holds_one_pair(spark, monkeypatch):
    """Blocks and slabs meet in groups of their own, not in one batch of all pairs; the rows are the same at any size of either."""
    rng = random.Random(5)
    vectors = [[rng.random() - 0.5 for _ in range(8)] for _ in range(300)]
    points = spark.createDataFrame([(f"p{i}", v) for i, v in enumerate(vectors)], "id string, vector array<float>")
    queries = spark.createDataFrame([(i, v) for i, v in enumerate(vectors) if i % 3 == 0], "query_id long, vector array<float>")
    monkeypatch.setattr(vector, "PART", 16)
    found = [sorted(tuple(r) for r in vector.batch_top_k(points, queries, 4, block=b, slab=s).collect()) for b, s in ((8192, 20_000), (30, 40))]
    assert found[0] == found[1] and len(found[0]) == 400
    plan = plan_of(vector.batch_top_k(points, queries, 4, block=30, slab=40))
    assert "CoGroup" in plan and "collect_list" not in plan


def test_edges_carry_their_order_once(spark, monkeypatch):
    """Fields that a query does not ask for are not shuffled beside the order."""
    assert plan_of(entry.queries()["graph_rename"](spark, SF)).count("ord2") == 0
    written = []
    kind = type(spark.range(1))
    whole = kind.hint
    monkeypatch.setattr(kind, "hint", lambda self, *a: (written.append(self.columns), whole(self, *a))[1])
    entry.queries()["graph_subgraph_stored"](spark, SF)
    assert sorted(written[0]) == sorted([*graph.KEY, "line", "bucket", "_first"])
