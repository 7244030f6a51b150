"""Queries of sources, sinks, functions, vector search, overlays and the graph."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from graincode.functions import scalars as fn
from graincode.operators import graph, overlay, vector
from graincode.sources import changes, config, languages, store

from . import projections as p
from .projections import EDGES, FILES, VECTORS
from .registry import query

LINEAGE = ["feature", "develop"]
V_COLS = "id, repo, branch, file, symbol, symbol_type, language, start_line, content_hash"
COLS = V_COLS.split(", ")
_L2 = "power(list_distance(vector::DOUBLE[], q::DOUBLE[]), 2)"
_COS = "list_inner_product(vector::DOUBLE[], q::DOUBLE[]) / (sqrt(list_inner_product(vector::DOUBLE[], vector::DOUBLE[])) * sqrt(list_inner_product(q::DOUBLE[], q::DOUBLE[])))"


def _tracked(spark, d):
    return p.files(spark, d).select(F.concat_ws("/", "repo", "branch", "file").alias("path"), "doc_id", fn.content_hash(F.col("content")).alias("content_hash"), "repo", "branch", "file", "content")


_TRACKED = FILES + ", tracked AS (SELECT repo || '/' || branch || '/' || file AS path, doc_id, sha256(content)[1:16] AS content_hash, repo, branch, file, content FROM files)"


@query(f"WITH {_TRACKED} SELECT path, 'added' AS status, NULL::VARCHAR AS old_path FROM tracked")
def src_full_listing(spark, d):
    return changes.full_listing(_tracked(spark, d))


def _diff_lines(spark, d):
    t, path, k = _tracked(spark, d), F.col("path"), F.col("doc_id") % 6
    line = F.when(k == 0, F.concat(F.lit("A\t"), path)).when(k == 1, F.concat(F.lit("M\t"), path)).when(k == 2, F.concat(F.lit("D\t"), path))
    line = line.when(k == 3, F.concat(F.lit("R100\told/"), path, F.lit("\t"), path)).when(k == 4, F.concat(F.lit("C75\tsrc/"), path, F.lit("\tcopy/"), path)).otherwise(F.concat(F.lit("T\t"), path))
    return t.select(line.alias("line"))


_DIFF = (
    _TRACKED
    + """, diff AS (SELECT CASE doc_id % 6 WHEN 4 THEN 'copy/' || path ELSE path END AS path,
    CASE doc_id % 6 WHEN 0 THEN 'added' WHEN 1 THEN 'modified' WHEN 2 THEN 'deleted' WHEN 3 THEN 'renamed' WHEN 4 THEN 'added' END AS status,
    CASE doc_id % 6 WHEN 3 THEN 'old/' || path END AS old_path FROM tracked WHERE doc_id % 6 <> 5)"""
)


@query(f"WITH {_DIFF} SELECT * FROM diff")
def src_name_status_parse(spark, d):
    return changes.parse_name_status(_diff_lines(spark, d))


@query(f"WITH {_DIFF} SELECT * FROM diff UNION ALL SELECT path, 'added', NULL FROM tracked WHERE doc_id % 6 = 5")
def src_dirty_union(spark, d):
    return changes.dirty(changes.parse_name_status(_diff_lines(spark, d)), _tracked(spark, d).where("doc_id % 6 = 5"))


@query(f"WITH {_TRACKED} SELECT DISTINCT t.path, t.content_hash, t.doc_id FROM (SELECT file AS path, content_hash, doc_id FROM tracked WHERE branch = 'feature') t WHERE NOT EXISTS (SELECT 1 FROM tracked b WHERE b.branch = 'main' AND b.file = t.path AND b.content_hash = t.content_hash)")
def src_branch_files(spark, d):
    t = _tracked(spark, d).select(F.col("file").alias("path"), "content_hash", "doc_id", "branch")
    return changes.branch_files(t.where("branch = 'feature'").drop("branch"), t.where("branch = 'main'"))


@query(f"WITH {_TRACKED} SELECT path, content, strlen(content)::INT AS bytes FROM tracked")
def src_file_content(spark, d):
    return _tracked(spark, d).select("path", "content", F.octet_length("content").alias("bytes"))


#: Fixed values, written out for the oracle apart from the code's own: extension and language.
_KNOWN = """
    ('.c', 'c'), ('.cc', 'cpp'), ('.cjs', 'javascript'), ('.cpp', 'cpp'), ('.cs', 'c_sharp'), ('.css', 'css'), ('.cxx', 'cpp'), ('.dart', 'dart'), ('.ex', 'elixir'),
    ('.exs', 'elixir'), ('.go', 'go'), ('.gql', 'graphql'), ('.graphql', 'graphql'), ('.h', 'c'), ('.hh', 'cpp'), ('.hpp', 'cpp'), ('.htm', 'html'), ('.html', 'html'),
    ('.java', 'java'), ('.js', 'javascript'), ('.json', 'json'), ('.jsx', 'javascript'), ('.kt', 'kotlin'), ('.kts', 'kotlin'), ('.less', 'less'), ('.lua', 'lua'),
    ('.md', 'markdown'), ('.mjs', 'javascript'), ('.mts', 'typescript'), ('.php', 'php'), ('.proto', 'protobuf'), ('.py', 'python'), ('.rb', 'ruby'), ('.rs', 'rust'),
    ('.sass', 'sass'), ('.sc', 'scala'), ('.scala', 'scala'), ('.scss', 'scss'), ('.sql', 'sql'), ('.svg', 'xml'), ('.swift', 'swift'), ('.ts', 'typescript'),
    ('.tsx', 'typescript'), ('.xml', 'xml'), ('.yaml', 'yaml'), ('.yml', 'yaml'), ('.zig', 'zig')"""
_ENDINGS = [*re.findall(r"'([.]\w+)',", _KNOWN), ".PY", ".Ts", ".bin", ""]


@query(f"""WITH known(e, language) AS (VALUES {_KNOWN}), paths AS (SELECT page_id, ({_ENDINGS})[(page_id % {len(_ENDINGS)} + 1)::INT] AS e FROM pages)
SELECT 'src/v1.2/f' || page_id || paths.e AS path, language FROM paths LEFT JOIN known ON known.e = lower(paths.e)""")
def src_detect_language(spark, d):
    ext = F.element_at(F.array(*[F.lit(e) for e in _ENDINGS]), (F.col("page_id") % len(_ENDINGS) + 1).cast("int"))
    t = p.table(spark, d, "pages").select(F.concat(F.lit("src/v1.2/f"), F.col("page_id").cast("string"), ext).alias("path"))
    return t.select("path", languages.detect_language(F.col("path")).alias("language"))


@query(f"""WITH {FILES}, l AS (SELECT doc_id, string_split(content, chr(10)) AS l, doc_id % 5 AS s, doc_id % 7 AS e, content FROM files)
SELECT doc_id, CASE WHEN s <= 0 THEN content WHEN s <= len(l) THEN array_to_string(l[s:CASE WHEN e <= 0 THEN len(l) ELSE least(e, len(l)) END], chr(10)) END AS excerpt,
       CASE WHEN s > len(l) THEN 'start line is beyond the end' END AS error FROM l""")
def src_read_lines(spark, d):
    return changes.read_lines(p.files(spark, d), (F.col("doc_id") % 5).cast("int"), (F.col("doc_id") % 7).cast("int")).select("doc_id", "excerpt", "error")


@query(f"WITH {VECTORS} SELECT {V_COLS} FROM vectors WHERE repo = 'src3'")
def src_scroll_all(spark, d):
    return store.scroll(p.vectors(spark, d), "src3").select(*COLS)


@query(f"WITH {VECTORS} SELECT repo, branch, count(*) AS points FROM vectors GROUP BY ALL")
def src_count(spark, d):
    return p.vectors(spark, d).groupBy("repo", "branch").agg(F.count(F.lit(1)).alias("points"))


def _new_points(spark, d):
    v = p.vectors(spark, d).where("vec_id % 5 = 0")
    return v.withColumns({"symbol": F.lit(None).cast("string"), "content_hash": F.concat(F.lit("new"), "content_hash"), "id": F.when(F.col("vec_id") % 10 == 0, F.concat(F.lit("n"), "id")).otherwise(F.col("id"))})


_NEW = VECTORS + """, fresh AS (SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN 'n' || id ELSE id END AS id, repo, branch, file, '' AS symbol, symbol_type, language, start_line, 'new' || content_hash AS content_hash
    FROM vectors WHERE vec_id % 5 = 0), last AS (SELECT * FROM fresh QUALIFY row_number() OVER (PARTITION BY id ORDER BY vec_id DESC) = 1)"""


@query(f"WITH {_NEW} SELECT {V_COLS} FROM vectors WHERE id NOT IN (SELECT id FROM last) UNION ALL SELECT {V_COLS} FROM last")
def sink_upsert(spark, d):
    return store.upsert(p.vectors(spark, d), _new_points(spark, d), "vec_id").select(*COLS)


@query(f"WITH {VECTORS}, gone AS (SELECT DISTINCT repo, branch, file FROM vectors WHERE vec_id % 7 = 0) SELECT {V_COLS} FROM vectors v WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.repo = v.repo AND g.branch = v.branch AND g.file = v.file)")
def sink_delete_by_file(spark, d):
    v = p.vectors(spark, d)
    return store.delete_files(v, v.where("vec_id % 7 = 0")).select(*COLS)


@query(f"""WITH {VECTORS}, moves AS (SELECT DISTINCT repo, branch, file, 'moved/' || file AS new_file FROM vectors WHERE vec_id % 7 = 0)
SELECT CASE WHEN new_file IS NULL THEN id ELSE sha256(v.repo || ':' || v.branch || ':' || new_file || ':' || start_line)[1:32] END AS id, v.repo, v.branch, coalesce(new_file, v.file) AS file,
       symbol, symbol_type, language, start_line, content_hash FROM vectors v LEFT JOIN moves m ON m.repo = v.repo AND m.branch = v.branch AND m.file = v.file""")
def sink_rename_file(spark, d):
    v = p.vectors(spark, d)
    moves = v.where("vec_id % 7 = 0").select("repo", "branch", "file", F.concat(F.lit("moved/"), "file").alias("new_file")).distinct()
    return store.rename_files(v, moves).select(*COLS)


@query(r"""SELECT page_id, CASE WHEN regexp_matches(r, ':\d+$') THEN regexp_replace(r, ':\d+$', '') ELSE r END AS host,
       CASE WHEN regexp_matches(r, ':\d+$') THEN regexp_extract(r, ':(\d+)$', 1)::INT ELSE 6334 END AS port
FROM (SELECT page_id, regexp_replace(regexp_extract(url, '^(https?://[^/]*)', 1) || (['', ':9999', ':notaport'])[(page_id % 3 + 1)::INT], '^https?://', '') AS r FROM pages)""")
def src_parse_endpoint(spark, d):
    tail = F.element_at(F.array(F.lit(""), F.lit(":9999"), F.lit(":notaport")), (F.col("page_id") % 3 + 1).cast("int"))
    host, port = config.parse_endpoint(F.concat(F.regexp_extract("url", "^(https?://[^/]*)", 1), tail))
    return p.table(spark, d, "pages").select("page_id", host.alias("host"), port.alias("port"))


@query("SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) ELSE '' END, ''), nullif(CASE WHEN c_custkey % 2 = 0 THEN c_name END, ''), 'local') AS setting FROM customer")
def src_config_precedence(spark, d):
    env = F.when(F.col("c_custkey") % 3 == 0, F.lower("c_mktsegment")).otherwise("")
    return p.table(spark, d, "customer").select("c_custkey", config.first_set(env, F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")), F.lit("local")).alias("setting"))


@query(f"WITH {_TRACKED} SELECT path FROM tracked WHERE NOT (file LIKE 'de/%' OR path LIKE 'src1/%' OR regexp_matches(path, '/f[0-9]\\.md$'))")
def src_exclude_globs(spark, d):
    return changes.exclude(_tracked(spark, d), ["**/de/*.md", "src1/**", "**/f?.md"]).select("path")


# functions


@query(f"WITH {FILES} SELECT doc_id, sha256(repo || ':' || branch || ':' || file || ':' || (doc_id % 9))[1:32] AS id, sha256(content)[1:16] AS content_hash FROM files")
def fn_deterministic_id(spark, d):
    f = p.files(spark, d)
    return f.select("doc_id", fn.deterministic_id(F.col("repo"), F.col("branch"), F.col("file"), F.col("doc_id") % 9).alias("id"), fn.content_hash(F.col("content")).alias("content_hash"))


@query(r"""SELECT event_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || printf('%02x', (('0x' || h[17:18])::INT & 63) | 128) || h[19:20] || '-' || h[21:32] AS uuid
FROM (SELECT event_id, sha1(unhex('a1b2c3d4e5f67890abcdef1234567890') || ('id' || event_id)::BLOB) AS h FROM events)""")
def fn_uuid5(spark, d):
    return p.table(spark, d, "events").select("event_id", fn.uuid5(F.concat(F.lit("id"), F.col("event_id").cast("string"))).alias("uuid"))


@query("SELECT page_id, regexp_extract(rtrim(url, '/'), '[^/]*$') AS repo FROM pages")
def fn_repo_name(spark, d):
    return p.table(spark, d, "pages").select("page_id", fn.repo_name(F.col("url")).alias("repo"))


@query("SELECT page_id, regexp_replace(regexp_extract(url, '[^/]*$'), '([^.])\\.[^.]*$', '\\1') AS stem FROM pages")
def fn_file_stem(spark, d):
    return p.table(spark, d, "pages").select("page_id", fn.file_stem(F.col("url")).alias("stem"))


_PARAMS = "'(' || replace(props, '\"', '') || ', ' || event_type || ' ,' || user_id || ')'"


@query(f"SELECT event_id, list_filter(list_transform(string_split(regexp_replace({_PARAMS}, '^\\s*\\(|\\)\\s*$', '', 'g'), ','), lambda x: trim(x)), lambda x: x <> '') AS params FROM events")
def fn_split_params(spark, d):
    text = F.concat(F.lit("("), F.replace("props", F.lit('"'), F.lit("")), F.lit(", "), "event_type", F.lit(" ,"), F.col("user_id").cast("string"), F.lit(")"))
    return p.table(spark, d, "events").select("event_id", fn.split_params(text).alias("params"))


@query("SELECT p_partkey, p_type || ' ' || p_name || CASE WHEN p_size % 2 = 0 THEN '((' || p_brand || '))' ELSE '' END || CASE WHEN p_size % 3 = 0 THEN ' -> ' || p_brand ELSE '' END AS signature FROM part")
def fn_signature(spark, d):
    params = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("("), "p_brand", F.lit(")"))).otherwise("")
    return p.table(spark, d, "part").select("p_partkey", fn.signature(F.col("p_type"), F.col("p_name"), params, F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).otherwise("")).alias("signature"))


_NAME = "CASE p_size % 3 WHEN 0 THEN '__' WHEN 1 THEN '_' ELSE '' END || p_name"


@query(f"SELECT p_partkey, CASE WHEN n LIKE '\\_\\_%' ESCAPE '\\' THEN 'private' WHEN n LIKE '\\_%' ESCAPE '\\' THEN 'protected' ELSE 'public' END AS visibility FROM (SELECT p_partkey, {_NAME} AS n FROM part)")
def fn_visibility(spark, d):
    return p.table(spark, d, "part").select("p_partkey", fn.visibility(F.expr(_NAME)).alias("visibility"))


@query("SELECT p_partkey, p_brand || '::' || CASE WHEN p_size % 2 = 0 THEN p_type || '.' ELSE '' END || p_name AS fqn FROM part")
def fn_fqn(spark, d):
    return p.table(spark, d, "part").select("p_partkey", fn.qualified_name(F.col("p_brand"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")), F.col("p_name")).alias("fqn"))


@query("SELECT doc_id, (length(text) // 4)::BIGINT AS tokens, (strlen(text) // 4)::BIGINT AS cost FROM documents")
def fn_token_estimate(spark, d):
    return p.table(spark, d, "documents").select("doc_id", fn.token_estimate(F.col("text")).alias("tokens"), fn.context_cost(F.col("text")).alias("cost"))


@query("SELECT event_id, json_extract_string(r, '$.method') AS method, json_extract_string(r, '$.params.user')::BIGINT AS user_id, json_extract(r, '$.params.k')::BIGINT AS k FROM (SELECT event_id, '{\"method\":\"' || event_type || '\",\"params\":{\"user\":\"' || user_id || '\",' || props[2:-2] || '}}' AS r FROM events)")
def json_request_parse(spark, d):
    request = F.concat(F.lit('{"method":"'), "event_type", F.lit('","params":{"user":"'), F.col("user_id").cast("string"), F.lit('",'), F.expr("substring(props, 2, length(props) - 2)"), F.lit("}}"))
    parsed = F.from_json(request, "method string, params struct<user:string,k:bigint>")
    return p.table(spark, d, "events").select("event_id", parsed.alias("r")).select("event_id", "r.method", F.col("r.params.user").cast("long").alias("user_id"), "r.params.k")


# vector search


@query(f"WITH {VECTORS}, h AS (SELECT id, {_L2} AS x FROM vectors, probe ORDER BY x, id LIMIT 10) SELECT id, round(x, 4) AS score FROM h")
def vec_topk_l2(spark, d):
    return vector.top_k(p.vectors(spark, d), p.probe(spark, d), 10).select("id", "score")


@query(f"WITH {VECTORS}, h AS (SELECT id, {_COS} AS x FROM vectors, probe ORDER BY x DESC, id LIMIT 10) SELECT id, round(x, 4) AS score FROM h")
def vec_topk_cosine(spark, d):
    return vector.top_k(p.vectors(spark, d), p.probe(spark, d), 10, "cosine").select("id", "score")


@query(f"WITH {VECTORS} SELECT {V_COLS} FROM vectors WHERE language = 'en' AND NOT is_deletion")
def vec_filter_eq(spark, d):
    return vector.where_metadata(p.vectors(spark, d), language="en", is_deletion=False).select(*COLS)


@query(f"WITH {VECTORS} SELECT {V_COLS} FROM vectors WHERE language IN ('de', 'fr') AND branch = 'main'")
def vec_filter_in(spark, d):
    return vector.where_metadata(p.vectors(spark, d), language=["de", "fr"], branch="main").select(*COLS)


@query(f"""WITH {VECTORS}, hits AS (SELECT *, {_L2} AS x FROM vectors, probe WHERE language = 'en' ORDER BY x, id LIMIT 30)
SELECT id, round(x, 4) AS score, file, symbol, symbol_type, start_line, end_line, language, text[1:500] AS text FROM hits QUALIFY row_number() OVER (PARTITION BY file, start_line ORDER BY x, id) = 1""")
def search(spark, d):
    return vector.search(p.vectors(spark, d), p.probe(spark, d), 30, language="en")


@query(f"""WITH {VECTORS}, five AS (SELECT *, {_L2} AS x FROM vectors, probe WHERE symbol_type IN ('function','method','class','struct','interface','enum') ORDER BY x, id LIMIT 5)
SELECT id, symbol, round(x, 4) AS score, CASE WHEN lower(symbol) = 'sym2' THEN 0 WHEN contains(lower(symbol), 'sym2') THEN 1 ELSE 2 END AS tier FROM five ORDER BY tier, x, id LIMIT 1""")
def read_symbol(spark, d):
    return vector.read_symbol(p.vectors(spark, d), p.probe(spark, d), "SYM2").select("id", "symbol", "score", "tier")


@query(f"""WITH {VECTORS}, l AS (SELECT id, {_L2} AS x FROM vectors, probe WHERE repo = 'nowhere' ORDER BY 2, 1 LIMIT 5), s AS (SELECT id, {_COS} AS x FROM vectors, probe WHERE branch = 'develop' ORDER BY 2 DESC, 1 LIMIT 5)
SELECT id, round(x, 4) AS score, 'l2' AS metric FROM l UNION ALL SELECT id, round(x, 4), 'cosine' FROM s WHERE NOT EXISTS (SELECT 1 FROM l)""")
def vec_hybrid_fallback(spark, d):
    v, q = p.vectors(spark, d), p.probe(spark, d)
    local = vector.top_k(vector.where_metadata(v, repo="nowhere"), q, 5).select("id", "score")
    return vector.hybrid_fallback(local, vector.top_k(vector.where_metadata(v, branch="develop"), q, 5, "cosine").select("id", "score"))


@query(f"WITH {VECTORS}, h AS (SELECT id, text, {_L2} AS x FROM vectors, probe ORDER BY 3, 1 LIMIT 10) SELECT id, printf('%.4f', round(x, 4)) AS score, array_to_string(string_split(text, chr(10))[1:4], chr(10)) AS preview FROM h")
def search_preview(spark, d):
    return vector.preview(vector.top_k(p.vectors(spark, d), p.probe(spark, d), 10))


@query("""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id::VARCHAR AS id, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) /
    (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))) AS x FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)
SELECT query_id, id, round(x, 4) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY x DESC, id) <= 10""")
def vec_batch_knn(spark, d):
    e = p.table(spark, d, "embeddings")
    return vector.batch_top_k(e.select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector")), e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), 10)


@query(f"WITH {VECTORS} SELECT {V_COLS} FROM vectors WHERE branch IN ('feature', 'develop')")
def overlay_filter(spark, d):
    return overlay.in_lineage(p.vectors(spark, d), LINEAGE).select(*COLS)


_RANK = "CASE branch WHEN 'feature' THEN 1 WHEN 'develop' THEN 2 ELSE 3 END"


@query(f"WITH {FILES} SELECT doc_id, file, branch FROM files QUALIFY row_number() OVER (PARTITION BY file ORDER BY {_RANK}, doc_id) = 1")
def overlay_dedup(spark, d):
    return overlay.overlay(p.files(spark, d), LINEAGE, "file", "doc_id").select("doc_id", "file", "branch")


@query(f"WITH {FILES} SELECT doc_id, file, branch FROM (SELECT doc_id, file, branch, doc_id % 4 = 0 AS gone FROM files QUALIFY row_number() OVER (PARTITION BY file ORDER BY {_RANK}, doc_id) = 1) WHERE NOT gone")
def overlay_tombstone(spark, d):
    rows = p.files(spark, d).withColumn("is_deletion", F.col("doc_id") % 4 == 0)
    return overlay.visible(rows, LINEAGE, True, "file", "doc_id").select("doc_id", "file", "branch")


# graph

_EKEY = "source, target, kind, repo, branch, source_file"
_TRIMMED = EDGES + f", trimmed AS (SELECT source, target, kind, rtrim(repo, '/') AS repo, branch, source_file, target_file, line, ord FROM edges), upserted AS (SELECT * FROM trimmed QUALIFY row_number() OVER (PARTITION BY {_EKEY} ORDER BY ord DESC) = 1)"


def _graph(spark, d, *more, ordered=False):
    """Folded edges, with target_file and line or those of them that are named, and their order only where it is asked for: every field is shuffled."""
    if not ordered:
        return graph.upsert(None, p.edges(spark, d).select(*graph.KEY, *(more or ("target_file", "line")), "ord"), "ord")
    return graph.upsert(None, p.edges(spark, d).withColumn("ord2", F.col("ord")), "ord").withColumnRenamed("ord2", "ord")


@query(f"WITH {_TRIMMED} SELECT {_EKEY}, line FROM upserted")
def graph_upsert(spark, d):
    e = p.edges(spark, d)
    return graph.upsert(graph.upsert(None, e.where("line <= 3")), e).select(*graph.KEY, "line")


@query(f"WITH {_TRIMMED} SELECT source, target, kind, repo, line, CASE source_file WHEN 'o7' THEN 'moved' ELSE source_file END AS source_file, CASE target_file WHEN 'o7' THEN 'moved' ELSE target_file END AS target_file FROM upserted")
def graph_rename(spark, d):
    return graph.rename_file(_graph(spark, d), "o7", "moved").select("source", "target", "kind", "repo", "line", "source_file", "target_file")


@query(f"WITH {_TRIMMED} SELECT {_EKEY}, line FROM upserted WHERE kind = 'calls' AND target = 'n7'")
def graph_callers(spark, d):
    return graph.callers(_graph(spark, d, "line"), "n7").select(*graph.KEY, "line")


@query(f"WITH {_TRIMMED} SELECT {_EKEY}, line FROM upserted WHERE kind = 'calls' AND source = 'n7'")
def graph_callees(spark, d):
    return graph.callees(_graph(spark, d, "line"), "n7").select(*graph.KEY, "line")


@query(f"WITH {_TRIMMED} SELECT DISTINCT source_file FROM upserted WHERE kind = 'imports' AND target_file = 'o7'")
def graph_dependents(spark, d):
    return graph.dependents(_graph(spark, d), "o7")


@query(f"WITH {_TRIMMED} SELECT DISTINCT target_file FROM upserted WHERE kind = 'imports' AND source_file = 'o20'")
def graph_dependencies(spark, d):
    return graph.dependencies(_graph(spark, d), "o20")


@query(f"WITH {_TRIMMED} SELECT {_EKEY}, line FROM upserted WHERE source ILIKE '%N4%' OR target ILIKE '%N4%'")
def graph_find_refs(spark, d):
    return graph.find_references(_graph(spark, d, "line"), "N4").select(*graph.KEY, "line")


@query(f"""WITH {_TRIMMED}, found AS (SELECT *, 1 AS pass FROM upserted WHERE (source ILIKE '%n7%' OR target ILIKE '%n7%') AND contains(repo, 'O')
    UNION ALL SELECT *, 2 FROM upserted WHERE (source ILIKE '%n12%' OR target ILIKE '%n12%') AND contains(repo, 'O')),
one AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY source_file, line, kind ORDER BY pass, ord) = 1)
SELECT source_file, line, kind, source, target, repo, pass, (SELECT count(*) FROM one) AS total FROM one ORDER BY pass, ord LIMIT 200""")
def get_references(spark, d):
    return graph.get_references(_graph(spark, d, ordered=True), "n7", "n12", "O")


@query(f"""WITH {_TRIMMED}, r1 AS (SELECT * FROM upserted WHERE source = 'n7' OR target = 'n7'), f2 AS (SELECT source AS node FROM r1 UNION SELECT target FROM r1 EXCEPT SELECT 'n7'),
r2 AS (SELECT * FROM upserted WHERE source IN (SELECT node FROM f2) OR target IN (SELECT node FROM f2))
SELECT {_EKEY}, line, 1 AS round FROM r1 UNION ALL SELECT {_EKEY}, line, 2 FROM r2""")
def graph_subgraph(spark, d):
    return graph.subgraph(_graph(spark, d, "line"), "n7", 2).select(*graph.KEY, "line", "round")


@query(f"WITH {_TRIMMED} SELECT source, target, kind, source_file, line, repo, branch, min(ord).a AS first FROM trimmed GROUP BY ALL")
def graph_normalize(spark, d):
    return graph.normalize(p.edges(spark, d)).select("source", "target", "kind", "source_file", "line", "repo", "branch", F.col("ord.l_orderkey").alias("first"))
