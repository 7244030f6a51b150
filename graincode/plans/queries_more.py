"""Queries of repositories, settings, more languages, remembering, moving points, whole index runs and streams that run."""

from __future__ import annotations

from pyspark.sql import functions as F

from graincode.functions import scalars as fn
from graincode.operators import embedding, index_state, indexing, memory, parsing, sync, vector
from graincode.sources import config, repository
from graincode.streaming import operators as streams

from . import projections as p
from graincode.functions.shared import checkpoint_folder, spread
from .projections import FILES, SAVES, STORES, VECTORS
from .queries_core import _L2
from .queries_state import _MEM, _memories, _sources
from .registry import ORACLES, query


# repositories, settings, dates


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'src/f' || page_id || '.py' WHEN 1 THEN 'new ' || page_id || '.txt' WHEN 2 THEN 'b/' || page_id ELSE 'gone' || page_id END AS path FROM pages")
def src_repo_state(spark, d):
    n = F.col("page_id").cast("string")
    line = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit(" M src/f"), n, F.lit(".py"))).when(F.col("page_id") % 4 == 1, F.concat(F.lit("?? new "), n, F.lit(".txt")))
    line = line.when(F.col("page_id") % 4 == 2, F.concat(F.lit("R  a/"), n, F.lit(" -> b/"), n)).otherwise(F.concat(F.lit(" D gone"), n))
    return p.table(spark, d, "pages").select("page_id", repository.dirty_path(line).alias("path"))


@query("""WITH s AS (SELECT p_partkey, (['local', 'Shared', 'HYBRID', '', 'cloud', NULL])[(p_partkey % 6 + 1)::INT] AS mode, CASE WHEN p_partkey % 4 < 2 THEN 'dir' ELSE '' END AS path, CASE WHEN p_partkey % 3 = 0 THEN 'host' END AS url, CASE WHEN p_partkey % 5 = 0 THEN 't' END AS token FROM part)
SELECT p_partkey, CASE WHEN coalesce(mode, '') IN ('', 'local') THEN CASE WHEN path = '' THEN 'local mode needs a local path' END
    WHEN mode = 'HYBRID' THEN CASE WHEN path = '' THEN 'hybrid mode needs a local path' WHEN url IS NULL THEN 'hybrid mode needs a shared address' END
    WHEN mode = 'Shared' THEN CASE WHEN url IS NULL THEN 'shared mode needs a shared address' WHEN token IS NULL THEN 'shared mode needs a token' END ELSE 'unknown mode cloud' END AS error FROM s""")
def src_settings_check(spark, d):
    k = F.col("p_partkey")
    mode = F.element_at(F.array(*[F.lit(x) for x in ("local", "Shared", "HYBRID", "", "cloud", None)]), (k % 6 + 1).cast("int"))
    error = config.settings_error(mode, F.when(k % 4 < 2, "dir").otherwise(""), F.when(k % 3 == 0, "host"), F.when(k % 5 == 0, "t"))
    return p.table(spark, d, "part").select("p_partkey", error.alias("error"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS iso, epoch_us(date_trunc('second', ts)) AS parsed FROM events")
def fn_iso_dates(spark, d):
    t = p.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    iso = fn.iso_utc(F.col("ts"))
    return t.select("event_id", iso.alias("iso"), F.unix_micros(fn.from_iso(F.concat(F.substring(iso, 1, 19), F.lit("Z")))).alias("parsed"))


# languages


_MORE = {
    "php": "<?php\nuse App\\m%d as M;\n\ninterface I%d {\n}\n\nfinal class K%d {\n    public function run($x) {\n        return helper($x);\n    }\n}\n\nfunction helper($v) {\n    return trim($v);\n}\n",
    "rust": "use a::m%d;\n\npub struct K%d {\n    a: i32,\n}\n\nimpl K%d {\n    pub fn run(&self, x: i32) -> i32 {\n        helper(x)\n    }\n}\n\nfn helper(v: i32) -> i32 {\n    v.abs()\n}\n",
    "javascript": "import { a, b } from './m%d';\n\nexport class K%d {\n  run(x) {\n    return helper(x);\n  }\n}\n\nconst arrow = (v) => {\n  return v;\n};\n\nexport async function helper(v) {\n  return arrow(v);\n}\n",
}


def _more(spark, d):
    n = F.col("p_partkey").cast("string")
    rows = F.array(*[F.struct(F.lit(k).alias("language"), F.lit(v).alias("template")) for k, v in _MORE.items()])
    t = spread(p.table(spark, d, "part").select("p_partkey"), "p_partkey").select("p_partkey", F.inline(rows))
    return t.select(F.concat(F.lit("src/"), "language", F.lit("/f"), n).alias("file"), "language", F.replace("template", F.lit("%d"), n).alias("content"))


_FILED = "'src/' || language || '/f' || p_partkey AS file"


@query(f"""WITH s(language, ord, name, kind, parent, start_line, end_line) AS (VALUES ('php', 0, 'I%', 'interface', NULL, 4, 5), ('php', 1, 'K%', 'class', NULL, 7, 11), ('php', 2, 'run', 'method', 'K%', 8, 10), ('php', 3, 'helper', 'function', NULL, 13, 15),
    ('rust', 0, 'K%', 'struct', NULL, 3, 5), ('rust', 1, 'K%', 'class', NULL, 7, 11), ('rust', 2, 'run', 'method', 'K%', 8, 10), ('rust', 3, 'helper', 'function', NULL, 13, 15),
    ('javascript', 0, 'K%', 'class', NULL, 3, 7), ('javascript', 1, 'run', 'method', 'K%', 4, 6), ('javascript', 2, 'arrow', 'function', NULL, 9, 11), ('javascript', 3, 'helper', 'function', NULL, 13, 15))
SELECT {_FILED}, ord::INT AS ord, replace(name, '%', p_partkey::VARCHAR) AS name, kind, replace(parent, '%', p_partkey::VARCHAR) AS parent, start_line::INT AS start_line, end_line::INT AS end_line FROM part, s""")
def parse_more_symbols(spark, d):
    return parsing.symbols_of(parsing.parse(_more(spark, d), parts=("symbols",))).select("file", "ord", "name", "kind", "parent", "start_line", "end_line")


@query(f"""WITH i(language, module, alias, names, line) AS (VALUES ('php', 'App\\m%', 'M', '', 2), ('rust', 'a::m%', NULL, '', 1), ('javascript', './m%', NULL, 'a,b', 1))
SELECT {_FILED}, replace(module, '%', p_partkey::VARCHAR) AS module, alias, names, line::INT AS line FROM part, i""")
def parse_more_imports(spark, d):
    return parsing.imports_of(parsing.parse(_more(spark, d), parts=("imports",))).select("file", "module", "alias", F.array_join("names", ",").alias("names"), "line")


@query(f"""WITH c(language, caller, callee, line) AS (VALUES ('php', 'run', 'helper', 9), ('php', 'helper', 'trim', 14), ('rust', 'run', 'helper', 9), ('rust', 'helper', 'abs', 14), ('javascript', 'run', 'helper', 5), ('javascript', 'helper', 'arrow', 14))
SELECT 'src/' || language || '/f' || p_partkey || '::' || caller AS source, callee AS target, {_FILED.replace("AS file", "AS source_file")}, line::INT AS line FROM part, c""")
def parse_more_calls(spark, d):
    return parsing.call_edges(parsing.parse(_more(spark, d), parts=("calls",))).select("source", "target", "source_file", "line")


@query("""WITH s(ord, name, kind, parent, start_line, end_line) AS (VALUES (0, 'K%', 'class', NULL, 3, 7), (1, 'run', 'method', 'K%', 4, 6), (2, 'helper', 'function', NULL, 9, 11))
SELECT 'k' || p_partkey || '.kt' AS file, ord::INT AS ord, replace(name, '%', p_partkey::VARCHAR) AS name, kind, replace(parent, '%', p_partkey::VARCHAR) AS parent, start_line::INT AS start_line, end_line::INT AS end_line, 'a.b' AS module FROM part, s""")
def parse_fallback(spark, d):
    n = F.col("p_partkey").cast("string")
    code = F.replace(F.lit("import a.b\n\nopen class K%d {\n  override fun run(x: Int): Int {\n    return helper(x)\n  }\n}\n\nfun helper(v: Int): Int {\n  return v\n}\n"), F.lit("%d"), n)
    files = spread(p.table(spark, d, "part").select("p_partkey"), "p_partkey").select(F.concat(F.lit("k"), n, F.lit(".kt")).alias("file"), F.lit("kotlin").alias("language"), code.alias("content"))
    parsed = parsing.parse(files, ("kotlin",), ("symbols", "imports"))
    each = parsed.select("file", F.col("imports.module").alias("module"), F.inline("symbols"))
    return each.select("file", "ord", "name", "kind", "parent", "start_line", "end_line", F.explode("module").alias("module"))


# embedding


@query(ORACLES["embed_hash"])
def embed_provider(spark, d):
    made = embedding.embed_with(lambda: embedding.create_provider({"provider": "hash", "dimension": 64}), F.col("text"))
    out = p.table(spark, d, "documents").select("doc_id", made.alias("vector"))
    return out.select("doc_id", *[F.round(F.element_at("vector", i).cast("double"), 4).alias(n) for i, n in ((1, "v0"), (64, "v63"))], F.size("vector").alias("dimension"))


# memory


_REMEMBER = SAVES + """, r AS (SELECT event_id AS memory_id, project, us, CASE WHEN event_id % 3 = 0 THEN '' ELSE content END AS given, CASE WHEN event_id % 9 = 0 THEN NULL ELSE content END AS text FROM saves),
good AS (SELECT memory_id, project, us, coalesce(nullif(given, ''), text) AS content FROM r WHERE coalesce(nullif(given, ''), text) IS NOT NULL),
titled AS (SELECT *, CASE WHEN memory_id % 2 = 0 THEN 'T' ELSE trim(replace(trim(string_split(trim(content), chr(10))[1]), '**What**:', ''))[1:80] END AS title, sha256(trim(regexp_replace(lower(content), '\\s+', ' ', 'g'))) AS h FROM good)"""


def _remembered(spark, d):
    s = p.saves(spark, d)
    given = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("content"))
    text = F.when(F.col("event_id") % 9 != 0, F.col("content"))
    rows = s.select(F.col("event_id").alias("memory_id"), given.alias("given"), text.alias("text"), F.when(F.col("event_id") % 2 == 0, "T").otherwise("").alias("title"), F.lit("").alias("memory_type"),
                    F.lit(None).cast("string").alias("scope"), "project", "topic_key", F.lit("a,b").alias("tags"), "us").withColumnRenamed("given", "content")
    return memory.remember(rows, lambda texts: texts.select("memory_id", F.array(F.octet_length("text").cast("double")).alias("vector")))


@query(f"""WITH {_REMEMBER} SELECT 'mem_' || h[1:24] AS id, arg_max(title, us) AS symbol, arg_max(title || chr(10) || content, us) AS text, 'note' AS memory_type, 'shared' AS memory_scope, h[1:16] AS content_hash,
    arg_max(strlen(title || ' ' || content), us)::DOUBLE AS v0 FROM titled GROUP BY h""")
def mem_remember_points(spark, d):
    return _remembered(spark, d)[0].select("id", "symbol", "text", "memory_type", "memory_scope", "content_hash", F.col("vector")[0].alias("v0"))


@query(f"WITH {_REMEMBER} SELECT memory_id, title, content, h AS hash, 'mem_' || h[1:24] AS vector_id, NULL::VARCHAR AS error FROM titled UNION ALL SELECT memory_id, NULL, NULL, NULL, NULL, 'content or text is required' FROM r WHERE memory_id % 9 = 0")
def mem_remember_rows(spark, d):
    _, rows, wrong = _remembered(spark, d)
    kept = rows.select("memory_id", "title", "content", "hash", "vector_id", F.lit(None).cast("string").alias("error"))
    return kept.unionByName(wrong, allowMissingColumns=True)


@query(f"WITH {_MEM} SELECT memory_id, title FROM memories WHERE memory_id = 17 AND NOT deleted")
def mem_by_id(spark, d):
    return memory.by_id(_memories(spark, d), 17).select("memory_id", "title")


@query(f"WITH {_MEM} SELECT memory_id FROM memories WHERE memory_id % 10 <> 3")
def mem_hard_delete(spark, d):
    m = _memories(spark, d)
    return memory.hard_delete(m, m.where("memory_id % 10 = 3")).select("memory_id")


@query(f"WITH {_MEM} SELECT memory_id, title FROM memories WHERE NOT deleted AND scope = 'shared' AND (title ILIKE '%tag7%' OR content ILIKE '%tag7%' OR memory_id % 21 = 7) ORDER BY updated DESC, memory_id DESC LIMIT 20")
def mem_search_tags(spark, d):
    m = _memories(spark, d).withColumn("tags", F.concat(F.lit("x,TAG"), (F.col("memory_id") % 21).cast("string"), F.lit(",y")))
    return memory.text_search(m.withColumn("tags", F.replace("tags", F.lit("TAG17"), F.lit("z"))), "tag7", scope="shared").select("memory_id", "title")


@query(f"""WITH {VECTORS}, m AS (SELECT * FROM vectors WHERE vec_id % 2 = 0 AND symbol_type IN ('method', 'class', 'struct', 'enum', 'module') AND repo = 'src2') SELECT id, round(x, 4) AS score FROM (SELECT id, {_L2} AS x FROM m, probe ORDER BY x, id LIMIT 15)""")
def mem_recall_filtered(spark, d):
    v = p.vectors(spark, d).withColumns({"chunk_level": F.when(F.col("vec_id") % 2 == 0, "memory").otherwise("function"), "memory_scope": F.lit("shared"), "project": F.col("repo"), "memory_type": F.when(F.col("symbol_type").isin("method", "class", "struct", "enum", "module"), "decision").otherwise("note")})
    return vector.top_k(memory.where_memory(v, "all", "decision", "src2"), p.probe(spark, d), 15).select("id", "score")


# sessions and records


@query("SELECT user_id AS owner, event_id AS session, ts AS started, CASE WHEN event_id = 5 THEN ts + INTERVAL 1 HOUR WHEN event_id % 2 = 0 THEN ts END AS ended FROM events")
def session_end(spark, d):
    s = p.table(spark, d, "events").select(F.col("user_id").alias("owner"), F.col("event_id").alias("session"), F.col("ts").alias("started"), F.when(F.col("event_id") % 2 == 0, F.col("ts")).alias("ended"))
    at = s.where("session = 5").select((F.col("started") + F.expr("INTERVAL 1 HOUR")).alias("at")).first()["at"]
    return index_state.end_session(index_state.end_session(s, 5, at), 4, at)


@query(f"WITH {FILES} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE 'old' END AS h FROM files WHERE doc_id % 5 <> 1")
def idx_put_records(spark, d):
    f = p.files(spark, d).select("doc_id", "repo", "branch", F.concat("file", F.lit("#"), F.col("doc_id").cast("string")).alias("file"), F.lit("old").alias("h"))
    put = index_state.put_records(f, f.where("doc_id % 2 = 0").withColumn("h", F.lit("new")))
    return index_state.remove_records(put, f.where("doc_id % 5 = 1")).select("doc_id", "h")


# moving points


@query(f"WITH {STORES}, m AS (SELECT * FROM local WHERE repo = 'src3' AND branch = 'main') SELECT id, content_hash, indexed_at FROM m UNION ALL SELECT id, content_hash, indexed_at FROM shared WHERE id NOT IN (SELECT id FROM m)")
def sync_push_rows(spark, d):
    return sync.push(*p.stores(spark, d), "src3", "main")[0].select("id", "content_hash", "indexed_at")


@query(f"WITH {STORES}, m AS (SELECT * FROM shared WHERE repo = 'src3') SELECT id, content_hash, indexed_at FROM m UNION ALL SELECT id, content_hash, indexed_at FROM local WHERE id NOT IN (SELECT id FROM m)")
def sync_pull_rows(spark, d):
    return sync.pull(*p.stores(spark, d), "src3")[0].select("id", "content_hash", "indexed_at")


# whole index runs: what was indexed before is every part's Python file but each seventh, and a file that is no longer there


def _before(spark, d):
    own = _sources(spark, d).where("language = 'python'")
    n = F.regexp_extract("file", r"(\d+)$", 1).cast("long")
    old = own.withColumn("n", n).where("n % 7 <> 0").select("file", "language", F.lit(4).alias("symbol_count"), fn.content_hash(F.concat("content", F.when(F.col("n") % 5 == 0, "x").otherwise(""))).alias("content_hash"), "n")
    lost = old.where("n % 13 = 1").select(F.concat(F.lit("lost/"), F.col("n").cast("string")).alias("file"), "language", "symbol_count", "content_hash", "n")
    return own, old.unionByName(lost).drop("n")


_LAST = "model string, last_commit string"


@query("""SELECT 'full' AS mode, count(*) FILTER (p_partkey % 11 <> 0) AS file_count, 4 * count(*) FILTER (p_partkey % 11 <> 0) AS symbol_count, count(*) FILTER (p_partkey % 11 <> 0) AS total_files,
    4 * count(*) FILTER (p_partkey % 11 <> 0) AS total_symbols, count(*) FILTER (p_partkey % 13 = 1 AND p_partkey % 7 <> 0) AS deleted_files FROM part""")
def index_repo_full(spark, d):
    """Another model than last time: every file is parsed again, files that vanished are deleted."""
    files, records = _before(spark, d)
    run = indexing.index_repo(files, records, spark.createDataFrame([("old", "c0")], _LAST), "new", files.limit(0).select(F.col("file").alias("path"), F.lit("added").alias("status"), F.lit("").alias("old_path")))
    return run["totals"].select(F.lit(run["mode"]).alias("mode"), "file_count", "symbol_count", "total_files", "total_symbols", "deleted_files")


@query("""WITH c AS (SELECT p_partkey AS n, p_partkey % 7 <> 0 AS known, p_partkey % 3 = 0 AS touched, p_partkey % 5 = 0 AND p_partkey % 7 <> 0 AS stale, p_partkey % 11 = 0 AS broken FROM part),
w AS (SELECT *, touched AND (NOT known OR stale) AS work FROM c)
SELECT 'incremental' AS mode, count(*) FILTER (work AND NOT broken) AS file_count, 4 * count(*) FILTER (work AND NOT broken) AS symbol_count, count(*) FILTER (known AND NOT work OR work AND NOT broken) AS total_files,
    4 * count(*) FILTER (known AND NOT work OR work AND NOT broken) AS total_symbols, count(*) FILTER (n % 13 = 1 AND known) AS deleted_files FROM w""")
def index_repo_incremental(spark, d):
    """Each third file is reported as modified, and the lost files as deleted; only those whose hash differs are parsed."""
    files, records = _before(spark, d)
    n = F.regexp_extract("file", r"(\d+)$", 1).cast("long")
    modified = files.where(n % 3 == 0).select(F.col("file").alias("path"), F.lit("modified").alias("status"))
    deleted = records.where("file LIKE 'lost/%'").select(F.col("file").alias("path"), F.lit("deleted").alias("status"))
    changes = modified.unionByName(deleted).withColumn("old_path", F.lit(None).cast("string"))
    run = indexing.index_repo(files, records, spark.createDataFrame([("m", "c0")], _LAST), "m", changes)
    return run["totals"].select(F.lit(run["mode"]).alias("mode"), "file_count", "symbol_count", "total_files", "total_symbols", "deleted_files")


@query(f"WITH {FILES} SELECT doc_id, file FROM files WHERE language IN ('en', 'de') AND regexp_matches(file, '^(en|de|fr)/f[^/]*[.]md$') AND NOT regexp_matches(file, '^[^/]*/f1[^/]*$')")
def index_selected(spark, d):
    f = p.files(spark, d)
    return indexing.selected(f, ["en/f*.md", "de/f*.md", "fr/**"], ["*/f1*"], ["en", "de"]).select("doc_id", "file")


# streams


@query("""SELECT page_id, path FROM (SELECT page_id, (['src/a', '.hidden', 'src/.env', 'x~', 'a.swp', 'b.tmp', 'node_modules/x', 'a/target/y', 'targets/y', 'src/~a'])[(page_id % 10 + 1)::INT] AS stem, stem || CASE WHEN page_id % 10 IN (0, 8) THEN page_id::VARCHAR ELSE '' END AS path FROM pages)
WHERE page_id % 10 IN (0, 8, 9)""")
def stream_watch_filter(spark, d):
    stem = F.element_at(F.array(*[F.lit(x) for x in ("src/a", ".hidden", "src/.env", "x~", "a.swp", "b.tmp", "node_modules/x", "a/target/y", "targets/y", "src/~a")]), (F.col("page_id") % 10 + 1).cast("int"))
    path = F.concat(stem, F.when((F.col("page_id") % 10).isin(0, 8), F.col("page_id").cast("string")).otherwise(""))
    return p.table(spark, d, "pages").select("page_id", path.alias("path")).where(streams.watchable(F.col("path")))


@query(ORACLES["mem_anchor_dedup"])
def stream_anchor_dedup(spark, d):
    """The saves as a stream of four micro-batches, up to two hours out of order, through state with timers, to the same rows as the batch form."""
    own = p.saves(spark, d).select("project", "us", (F.col("us") + F.pmod(F.xxhash64("event_id"), F.lit(7_200_000_000))).alias("comes"))
    stream = streams.replay(own, checkpoint_folder(spark), F.col("comes"), 4)
    return streams.run_anchor_stream(stream, ["project"], checkpoint_folder(spark), "2 hours", 6 * 3600)
