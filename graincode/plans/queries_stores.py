"""Queries of searches over a lineage, whole memory rows, replays, trees and sinks."""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from graincode.operators import embedding, graph, indexing, memory, vector
from graincode.sources import point_sink, tree
from graincode.sources.store import VersionedTable
from graincode.streaming import operators as streams

from . import projections as p
from graincode.functions.shared import checkpoint_folder, cut, shuffled
from .projections import SAVES, STORES, VECTORS
from .queries_core import _L2, _TRIMMED, _graph
from .queries_state import _MEM, _memories, _sources
from .registry import ORACLES, query

# searches over a branch lineage: most rows of feature are deletions, so that they hide rows of develop and main

_SEEN = f"""{VECTORS}, marked AS (SELECT * EXCLUDE (is_deletion), CASE WHEN branch = 'feature' THEN vec_id % 4 <> 1 ELSE vec_id % 11 = 0 END AS is_deletion,
    CASE branch WHEN 'feature' THEN 1 WHEN 'develop' THEN 2 ELSE 3 END AS place, 'f' || (vec_id % 90) AS own FROM vectors),
firsts AS (SELECT repo, own, min(place) AS first FROM marked GROUP BY ALL),
seen AS (SELECT m.*, {_L2} AS x FROM marked m JOIN firsts f ON f.repo = m.repo AND f.own = m.own AND f.first = m.place, probe WHERE NOT is_deletion)"""


def _marked(spark, d):
    v = p.vectors(spark, d).withColumn("file", F.concat(F.lit("f"), (F.col("vec_id") % 90).cast("string")))
    return v.withColumn("is_deletion", F.when(F.col("branch") == "feature", F.col("vec_id") % 4 != 1).otherwise(F.col("vec_id") % 11 == 0))


@query(f"""WITH {_SEEN}, hits AS (SELECT * FROM seen ORDER BY x, id LIMIT 30)
SELECT id, round(x, 4) AS score, own AS file, symbol, symbol_type, start_line, end_line, language, text[1:500] AS text FROM hits QUALIFY row_number() OVER (PARTITION BY own, start_line ORDER BY x, id) = 1""")
def search_lineage(spark, d):
    return vector.search(_marked(spark, d), p.probe(spark, d), 30, lineage=["feature", "develop", "main"])


@query(f"WITH {_SEEN} SELECT id, branch, own AS file, round(x, 4) AS score FROM seen ORDER BY x, id LIMIT 100")
def vec_topk_lineage(spark, d):
    """A hundred points, where most of the nearest ones are hidden: the search widens until it has them."""
    hits = vector.lineage_nearest(_marked(spark, d), p.probe(spark, d), 100, ["feature", "develop", "main"], widen=2)
    return hits.select("id", "branch", "file", F.round("score", 4).alias("score"))


# memory: whole rows, saved in two runs, the second on top of what the first stored

_WHOLE = SAVES + """, own AS (SELECT * REPLACE (sha256(hash || ':' || CASE WHEN event_id % 4 = 0 AND event_id % 12 <> 0 THEN event_id ELSE event_id % 40 END) AS hash), trim(replace(trim(string_split(trim(content), chr(10))[1]), '**What**:', ''))[1:80] AS title, 't' || (event_id % 5) AS tags,
    'a' || (event_id % 3) AS author, 'r' || (event_id % 2) AS repo, 'b' || (event_id % 4) AS branch, 'f' || event_id AS files FROM saves),
s AS (SELECT project, scope, us, event_id, hash, topic_key, row_number() OVER (PARTITION BY project, scope ORDER BY us, event_id) AS i FROM own),
f(project, scope, i, l) AS (SELECT DISTINCT project, scope, 0::BIGINT, []::STRUCT(e BIGINT, w BIGINT, h VARCHAR, k VARCHAR, c BIGINT, u BIGINT, r BIGINT, d BIGINT)[] FROM s
    UNION ALL SELECT project, scope, i, CASE WHEN t > 0 THEN list_transform(l, lambda x, j: CASE WHEN j = t THEN {'e': x.e, 'w': event_id, 'h': hash, 'k': x.k, 'c': x.c, 'u': us, 'r': x.r + 1, 'd': x.d} ELSE x END)
        WHEN n > 0 THEN list_transform(l, lambda x, j: CASE WHEN j = n THEN {'e': x.e, 'w': x.w, 'h': x.h, 'k': x.k, 'c': x.c, 'u': us, 'r': x.r, 'd': x.d + 1} ELSE x END)
        ELSE list_append(l, {'e': event_id, 'w': event_id, 'h': hash, 'k': topic_key, 'c': us, 'u': us, 'r': 1::BIGINT, 'd': 0::BIGINT}) END
    FROM (SELECT s.*, f.l, CASE WHEN topic_key IS NULL THEN 0 ELSE coalesce(list_position(list_transform(l, lambda x: x.k), topic_key), 0) END AS t,
            coalesce(list_max(list_transform(l, lambda x, j: CASE WHEN x.h = hash AND x.c > us - 2592000000000 THEN j ELSE 0 END)), 0) AS n
        FROM f JOIN s ON s.project = f.project AND s.scope = f.scope AND s.i = f.i + 1)),
last AS (SELECT project, scope, l FROM f QUALIFY row_number() OVER (PARTITION BY project, scope ORDER BY i DESC) = 1),
each AS (SELECT project, scope, unnest(l) AS x, (generate_subscripts(l, 1) - 1)::BIGINT AS row FROM last)"""


def _saved(spark, d):
    """saves, the rows of a first run over their earlier half, and those of a second run over the rest."""
    n = F.col("event_id")
    text = lambda head, by: F.concat(F.lit(head), (n % by).cast("string"))
    own = p.saves(spark, d).withColumns({"hash": F.sha2(F.concat("hash", F.lit(":"), F.when((n % 4 == 0) & (n % 12 != 0), n).otherwise(n % 40).cast("string")), 256), "title": memory.auto_title(F.col("content")), "tags": text("t", 5), "author": text("a", 3), "repo": text("r", 2),
                                         "branch": text("b", 4), "files": F.concat(F.lit("f"), n.cast("string"))})
    half = own.agg(F.avg("us").cast("long")).first()[0]
    window = 30 * 86_400
    first = cut(memory.save_rows(own.where(F.col("us") <= half), window))
    late = own.where(F.col("us") > half)
    return own, late, first, memory.save_rows(late, window, first)


@query(f"""WITH RECURSIVE {_WHOLE} SELECT e.project, e.scope, row, x.e AS first_event, x.h AS hash, x.k AS topic_key, x.c AS created, x.u AS updated, x.r AS revision, x.d AS duplicates,
    o.title, o.content, o.memory_type, o.tags, o.author, o.repo, o.branch, o.files, 'mem_' || x.h[1:24] AS vector_id FROM each e JOIN own o ON o.event_id = x.w""")
def mem_save_rows(spark, d):
    return _saved(spark, d)[3].drop("content_event", "changed")


@query(f"""WITH RECURSIVE {_WHOLE} SELECT DISTINCT 'mem_' || hash[1:24] AS vector_id FROM own WHERE hash NOT IN (SELECT x.h FROM each)""")
def mem_orphan_vectors(spark, d):
    """What both runs together leave behind: the second also finds what the first one's topic saves had replaced, by that run's own call."""
    own, late, first, after = _saved(spark, d)
    after = cut(after)
    gone = memory.orphan_vectors(own.join(late, "event_id", "left_anti"), first)
    return gone.join(after, "vector_id", "left_anti").unionByName(memory.orphan_vectors(late, after, first)).distinct()


@query(ORACLES["mem_anchor_dedup"])
def mem_anchor_spread(spark, d):
    """The rows of mem_anchor_dedup, each key spread over tasks."""
    return memory.anchors_spread(p.saves(spark, d), ["project"], 6 * 3600)


@query(f"""WITH {_MEM} SELECT memory_id, CASE WHEN memory_id % 7 = 0 THEN 'x' ELSE 'a,b' END AS tags, CASE WHEN memory_id % 21 = 0 THEN 'f.py' ELSE '' END AS files,
    CASE WHEN memory_id % 14 = 0 THEN 'moved' ELSE topic_key END AS topic_key, CASE WHEN memory_id % 7 = 0 THEN 2 ELSE 1 END::INT AS revision FROM memories""")
def mem_update_fields(spark, d):
    m = _memories(spark, d).withColumns({"tags": F.lit("a,b"), "files": F.lit("")})
    n = F.col("memory_id")
    new = m.where(n % 7 == 0).select("memory_id", F.lit("x").alias("tags"), F.when(n % 21 == 0, "f.py").alias("files"), F.when(n % 14 == 0, "moved").alias("topic_key"))
    return memory.partial_update(m, new).select("memory_id", "tags", "files", "topic_key", "revision")


# retries: odd events check the health of a user's store, even ones are operations; those above 95 fail at their first attempt


def _send(store: str, seq: int, operation: str, attempt: int) -> None:
    if attempt == 0 and float(operation) > 95:
        raise OSError("not now")


@query("""WITH RECURSIVE own AS (SELECT user_id::VARCHAR AS store, event_id AS seq, event_id % 2 = 1 AS is_check, value, least(event_id * 6 // (SELECT max(event_id) FROM events), 5) AS b FROM events),
known AS (SELECT *, coalesce(last_value(CASE WHEN is_check THEN value >= 50 END IGNORE NULLS) OVER (PARTITION BY store ORDER BY seq), true) AS up FROM own),
batches AS (SELECT store, g.b, coalesce(list({'s': seq, 'bad': value > 95, 'up': up} ORDER BY seq) FILTER (NOT is_check AND known.b = g.b), []) AS ops,
        coalesce(bool_or(is_check AND value < 50 AND known.b = g.b), false) AS fell, coalesce(arg_max(value >= 50, seq) FILTER (is_check AND known.b <= g.b), true) AS now
    FROM known, generate_series(0, 5) AS g(b) GROUP BY ALL),
steps AS (SELECT *, coalesce(lag(now) OVER (PARTITION BY store ORDER BY b), true) AS was FROM batches),
f(store, b, wait, sent) AS (SELECT DISTINCT store, -1::BIGINT, []::STRUCT(s BIGINT, bad BOOLEAN)[], []::STRUCT(s BIGINT, state VARCHAR, b BIGINT)[] FROM known
    UNION ALL SELECT store, b, CASE WHEN NOT rise THEN q WHEN pos IS NULL THEN [] ELSE list_transform(q[pos:], lambda x, i: {'s': x.s, 'bad': x.bad AND i > 1}) END,
        sent || direct || CASE WHEN rise THEN list_transform(q[1:coalesce(pos - 1, len(q))], lambda x: {'s': x.s, 'state': 'flushed', 'b': b}) ELSE [] END
    FROM (SELECT *, list_position(list_transform(q, lambda x: x.bad), true) AS pos FROM (SELECT f.store, s.b, f.sent, s.now AND (NOT s.was OR s.fell) AS rise,
        f.wait || list_transform(list_filter(s.ops, lambda x: NOT x.up OR x.bad), lambda x: {'s': x.s, 'bad': x.bad AND NOT x.up}) AS q,
        list_transform(list_filter(s.ops, lambda x: x.up AND NOT x.bad), lambda x: {'s': x.s, 'state': 'direct', 'b': s.b}) AS direct FROM f JOIN steps s ON s.store = f.store AND s.b = f.b + 1)))
SELECT store, x.s AS seq, x.state AS state, x.b::INT AS batch FROM (SELECT store, unnest(sent) AS x FROM f WHERE b = 5)
UNION ALL SELECT store, x.s, 'waiting', NULL FROM (SELECT store, unnest(wait) AS x FROM f WHERE b = 5)""")
def retry_replay(spark, d):
    """Six micro-batches of checks and operations through the log: what was applied at once, by which flush, and what still waits."""
    e = p.table(spark, d, "events")
    last = e.agg(F.max("event_id")).first()[0]
    check = F.col("event_id") % 2 == 1
    rows = e.select(F.col("user_id").cast("string").alias("store"), F.col("event_id").alias("seq"), F.when(check, F.col("value") >= 50).alias("healthy"), F.when(~check, F.col("value").cast("string")).alias("operation"))
    stream = streams.replay(rows, checkpoint_folder(spark), F.col("seq"), 6, [-(-last * k // 6) - 1 for k in range(1, 6)])
    return streams.RetryLog(spark, checkpoint_folder(spark), _send).run(stream)


# trees: every document as a file, written by the tasks into the shared folder, which here must be a mounted one


def _mounted(spark) -> str:
    folder = checkpoint_folder(spark)
    if "://" in folder.removeprefix("file://"):
        raise ValueError("the shared folder is not a mounted one")
    return f"{folder.removeprefix('file://').removeprefix('file:')}/tree-{uuid.uuid4().hex}"


def _tree_of(spark, d):
    root = _mounted(spark)

    def put(batches):
        for batch in batches:
            for path, text in zip(*(c.to_pylist() for c in batch.columns)):
                at = f"{root}/{path}"
                os.makedirs(os.path.dirname(at), exist_ok=True)
                with open(f"{at}.{uuid.uuid4().hex}", "w", newline="") as f:
                    f.write(text or "")
                os.replace(f.name, at)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    path = F.concat("source", F.lit("/"), "lang", F.lit("/d"), (F.col("doc_id") % 7).cast("string"), F.lit("/é "), F.col("doc_id").cast("string"), F.lit(".md"))
    p.table(spark, d, "documents").select(path.alias("path"), "text").mapInArrow(put, "n long").agg(F.sum("n")).collect()
    tree.register(spark)
    return root


@query("SELECT source || '/' || lang || '/d' || (doc_id % 7) || '/é ' || doc_id || '.md' AS path, strlen(text)::BIGINT AS bytes, sha256(text) AS hash FROM documents")
def src_tree_source(spark, d):
    """Listing and contents of a tree, read by tasks in ranges of paths."""
    t = spark.read.format("source_tree").option("ranges", "12").load(_tree_of(spark, d))
    return t.select("path", "bytes", F.sha2("content", 256).alias("hash"))


# pushing in batches: batches with an id that begins with 00 fail


class PickyClient(point_sink.FolderClient):
    def upsert(self, rows):
        if any(r["id"].startswith("00") for r in rows):
            raise OSError("00")
        super().upsert(rows)


_BATCHED = f"""WITH {STORES}, b AS (SELECT *, ('0x' || id[1:2])::INT % 16 AS slot FROM local), n AS (SELECT *, (row_number() OVER (PARTITION BY branch, slot ORDER BY id) - 1) // 1000 AS part FROM b),
batches AS (SELECT branch, slot, part, count(*) AS n, bool_or(starts_with(id, '00')) AS failed FROM n GROUP BY ALL)"""


def _pushed(spark, d):
    local = p.stores(spark, d)[0].withColumn("slot", (F.conv(F.substring("id", 1, 2), 16, 10).cast("int") % 16))
    folder = checkpoint_folder(spark)
    folder = folder if "://" in folder else f"file://{folder.removeprefix('file:')}"
    target = f"{folder}/pushed-{uuid.uuid4().hex}"
    report = point_sink.push_batches(local, folder, {"client": f"{__name__}:PickyClient", "target": target}, ("branch", "slot"))
    return report, target


@query(f"""{_BATCHED} SELECT branch, coalesce(sum(n) FILTER (NOT failed), 0)::BIGINT AS points, coalesce(sum(n) FILTER (failed), 0)::BIGINT AS failed_points, count(*) FILTER (NOT failed) AS batches,
    count(*) FILTER (failed) AS failed_batches, CASE WHEN bool_or(failed) THEN '00' ELSE '' END AS error FROM batches GROUP BY branch""")
def sync_push_batches(spark, d):
    return _pushed(spark, d)[0].select("branch", "points", "failed_points", "batches", "failed_batches", F.coalesce(F.try_element_at("errors", F.lit(1)), F.lit("")).alias("error"))


@query(f"""{_BATCHED} SELECT id, n.branch, content_hash FROM n JOIN batches b ON b.branch = n.branch AND b.slot = n.slot AND b.part = n.part WHERE NOT failed""")
def sync_push_stored(spark, d):
    """What the store holds after that."""
    return spark.read.parquet(_pushed(spark, d)[1]).select("id", "branch", "content_hash")


# references of a symbol whose file is looked up among the points


@query(f"""WITH {_TRIMMED}, {VECTORS}, located AS (SELECT 'n' || (vec_id % 30 + 10) AS stem FROM vectors, probe WHERE vec_id % 10 = 7 ORDER BY {_L2}, id LIMIT 1),
found AS (SELECT *, 1 AS pass FROM upserted WHERE (source ILIKE '%n7%' OR target ILIKE '%n7%') AND contains(repo, 'F')
    UNION ALL SELECT u.*, 2 FROM upserted u, located WHERE (source ILIKE '%' || stem || '%' OR target ILIKE '%' || stem || '%') AND contains(repo, 'F')),
one AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY source_file, line, kind ORDER BY pass, ord) = 1)
SELECT source_file, line, kind, source, target, repo, pass, (SELECT count(*) FROM one) AS total FROM one ORDER BY pass, ord LIMIT 200""")
def get_references_located(spark, d):
    n = F.col("vec_id")
    points = p.vectors(spark, d).withColumns({"symbol": F.concat(F.lit("n"), (n % 10).cast("string")), "file": F.concat(F.lit("src/n"), (n % 30 + 10).cast("string"), F.lit(".md"))})
    return graph.references(_graph(spark, d, ordered=True), points, p.probe(spark, d), "n7", "/repos/F/")


# index runs that end in stores: a full one, then one with files deleted, renamed and changed


@query("""SELECT CASE WHEN p_partkey % 5 = 1 THEN 'moved/f' ELSE 'src/python/f' END || p_partkey AS file, 4::BIGINT AS points, (5 + (p_partkey % 5 = 2)::INT)::BIGINT AS edges,
    CASE WHEN p_partkey % 5 = 1 THEN 'moved/f' ELSE 'src/python/f' END || p_partkey || '::<module>' AS first_source, (4 + (p_partkey % 5 = 2)::INT)::BIGINT AS symbols, CASE WHEN p_partkey % 5 = 2 THEN 'c2' ELSE 'c1' END AS commit
FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 5 <> 0""")
def index_repo_stored(spark, d):
    folder = f"{checkpoint_folder(spark)}/index-{uuid.uuid4().hex}"
    stores = [VersionedTable(spark, f"{folder}/{x}", buckets=8) for x in ("points", "edges", "records")]
    embed = lambda texts: embedding.hash_embed(texts, ["id"], "text")
    files = _sources(spark, d).where("language = 'python'")
    n = F.regexp_extract("file", r"(\d+)$", 1).cast("long")
    last = "model string, last_commit string"
    none = spark.createDataFrame([], "file string, language string, symbol_count int, content_hash string")
    first = indexing.index_repo(files, none, spark.createDataFrame([], last), "m", keep=True)
    indexing.store_run(first, "r", "main", embed, *stores, commit="c1")
    path = F.when(n % 5 == 1, F.concat(F.lit("moved/f"), n.cast("string"))).otherwise(F.col("file"))
    now = files.where(n % 5 != 0).select(path.alias("file"), "language", F.when(n % 5 == 2, F.concat("content", F.lit("\ndef extra():\n    helper(1)\n"))).otherwise(F.col("content")).alias("content"))
    status = F.when(n % 5 == 0, "deleted").when(n % 5 == 1, "renamed").otherwise("modified")
    changes = files.where(n % 5 < 3).select(path.alias("path"), status.alias("status"), F.when(n % 5 == 1, F.col("file")).alias("old_path"))
    known = stores[2].read().select("file", "language", "symbol_count", "content_hash")
    second = indexing.index_repo(now, known, spark.createDataFrame([("m", "c1")], last), "m", changes, keep=True)
    indexing.store_run(second, "r", "main", embed, *stores, commit="c2")
    points, edges, records = (s.read() for s in stores)
    out = points.groupBy("file").agg(F.count(F.lit(1)).alias("points"), F.max("commit").alias("commit"))
    out = out.join(shuffled(edges.groupBy("file").agg(F.count(F.lit(1)).alias("edges"), F.min("source").alias("first_source"))), "file", "full")
    return out.join(shuffled(records.select("file", F.col("symbol_count").cast("long").alias("symbols"))), "file", "full").select("file", "points", "edges", "first_source", "symbols", "commit")


# the neighbourhood of a symbol over stored adjacency


@query(ORACLES["graph_subgraph"])
def graph_subgraph_stored(spark, d):
    own = graph.Adjacency(spark, f"{checkpoint_folder(spark)}/adjacency-{uuid.uuid4().hex}")
    own.write(_graph(spark, d, "line").select(*graph.KEY, "line"))
    return own.subgraph("n7", 2).select(*graph.KEY, "line", "round")
