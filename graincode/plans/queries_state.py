"""Queries of memory, index state, sync, context, chunking, parsing, embedding, indexing and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from graincode.functions import scalars as fn
from graincode.operators import chunking, context, embedding, index_state, indexing, memory, parsing, sync, vector
from graincode.sources.languages import support_matrix
from graincode.streaming import operators as streams

from . import projections as p
from graincode.functions.shared import checkpoint_folder, cut, spread
from .projections import FILES, INDEX_STATE, SAVES, STORES, VECTORS
from .queries_core import _L2
from .registry import query

# memory


def _memories(spark, d):
    """One memory a save, with the columns of stored rows."""
    s = p.saves(spark, d)
    return s.select(F.col("event_id").alias("memory_id"), "project", "scope", "topic_key", "memory_type", "content", fn.auto_title(F.col("content")).alias("title"), "deleted",
                    F.col("us").alias("created"), (F.col("us") + F.col("event_id") % 1000).alias("updated"), F.lit(1).alias("revision"))


_MEM = SAVES + """, memories AS (SELECT event_id AS memory_id, project, scope, topic_key, memory_type, content,
    trim(replace(trim(string_split(trim(content), chr(10))[1]), '**What**:', ''))[1:80] AS title, deleted, us AS created, us + event_id % 1000 AS updated, 1 AS revision FROM saves)"""


@query(f"""WITH RECURSIVE {SAVES}, s AS (SELECT project, us, row_number() OVER (PARTITION BY project ORDER BY us) AS i FROM saves),
f(project, i, anchor) AS (SELECT project, 1, us FROM s WHERE i = 1
    UNION ALL SELECT s.project, f.i + 1, CASE WHEN s.us - f.anchor < 21600000000 THEN f.anchor ELSE s.us END FROM f JOIN s ON s.project = f.project AND s.i = f.i + 1)
SELECT project, anchor, count(*) AS n FROM f GROUP BY ALL""")
def mem_anchor_dedup(spark, d):
    return memory.anchors(p.saves(spark, d), ["project"], 6 * 3600)


@query(f"""WITH RECURSIVE {SAVES}, s AS (SELECT project, scope, us, event_id, hash, topic_key, row_number() OVER (PARTITION BY project, scope ORDER BY us, event_id) AS i FROM saves),
f(project, scope, i, l) AS (SELECT DISTINCT project, scope, 0::BIGINT, []::STRUCT(e BIGINT, h VARCHAR, k VARCHAR, c BIGINT, u BIGINT, r BIGINT, d BIGINT)[] FROM s
    UNION ALL SELECT project, scope, i, CASE WHEN t > 0 THEN list_transform(l, lambda x, j: CASE WHEN j = t THEN {{'e': x.e, 'h': hash, 'k': x.k, 'c': x.c, 'u': us, 'r': x.r + 1, 'd': x.d}} ELSE x END)
        WHEN n > 0 THEN list_transform(l, lambda x, j: CASE WHEN j = n THEN {{'e': x.e, 'h': x.h, 'k': x.k, 'c': x.c, 'u': us, 'r': x.r, 'd': x.d + 1}} ELSE x END)
        ELSE list_append(l, {{'e': event_id, 'h': hash, 'k': topic_key, 'c': us, 'u': us, 'r': 1::BIGINT, 'd': 0::BIGINT}}) END
    FROM (SELECT s.*, f.l, CASE WHEN topic_key IS NULL THEN 0 ELSE coalesce(list_position(list_transform(l, lambda x: x.k), topic_key), 0) END AS t,
            coalesce(list_max(list_transform(l, lambda x, j: CASE WHEN x.h = hash AND x.c > us - 21600000000 THEN j ELSE 0 END)), 0) AS n
        FROM f JOIN s ON s.project = f.project AND s.scope = f.scope AND s.i = f.i + 1)),
last AS (SELECT project, scope, l FROM f QUALIFY row_number() OVER (PARTITION BY project, scope ORDER BY i DESC) = 1),
each AS (SELECT project, scope, unnest(l) AS x, (generate_subscripts(l, 1) - 1)::BIGINT AS row FROM last)
SELECT project, scope, row, x.e AS first_event, x.h AS hash, x.k AS topic_key, x.c AS created, x.u AS updated, x.r AS revision, x.d AS duplicates FROM each""")
def mem_save_fold(spark, d):
    return memory.save_fold(p.saves(spark, d), 6 * 3600).drop("content_event", "changed")


@query("SELECT doc_id, sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS hash FROM documents")
def mem_norm_hash(spark, d):
    return p.table(spark, d, "documents").select("doc_id", fn.normalized_hash(F.col("text")).alias("hash"))


@query(f"""WITH {SAVES} SELECT project, scope, topic_key, arg_max(content, (us, event_id)) AS content, arg_max(memory_type, (us, event_id)) AS memory_type, count(*) AS revision, min(us) AS created
FROM saves WHERE coalesce(topic_key, '') <> '' GROUP BY project, scope, topic_key""")
def mem_topic_upsert(spark, d):
    return memory.topic_upsert(p.saves(spark, d))


@query(f"WITH {_MEM} SELECT memory_id, title FROM memories")
def mem_auto_title(spark, d):
    return _memories(spark, d).select("memory_id", "title")


@query(f"""WITH {VECTORS}, {_MEM}, h AS (SELECT id, round(x, 4) AS score, vec_id FROM (SELECT id, {_L2} AS x, vec_id FROM vectors, probe ORDER BY 2, 1 LIMIT 20)),
live AS (SELECT v.id, m.* FROM vectors v JOIN memories m ON m.memory_id = v.vec_id AND v.vec_id % 2 = 0 WHERE NOT m.deleted QUALIFY row_number() OVER (PARTITION BY v.id ORDER BY memory_id) = 1)
SELECT h.id, h.score, coalesce(title, '') AS title, coalesce(content, '') AS content, coalesce(memory_type, '') AS memory_type, live.id IS NOT NULL AS found FROM h LEFT JOIN live ON live.id = h.id""")
def mem_recall(spark, d):
    v = p.vectors(spark, d)
    hits = vector.top_k(v, p.probe(spark, d), 20).select("id", "score")
    linked = _memories(spark, d).join(v.where("vec_id % 2 = 0").select(F.col("vec_id").alias("memory_id"), F.col("id").alias("vector_id")), "memory_id")
    return memory.recall(hits, linked)


@query(f"WITH {_MEM} SELECT memory_id, title, topic_key FROM memories WHERE NOT deleted AND topic_key = 't1' ORDER BY updated DESC, memory_id DESC LIMIT 1")
def mem_by_topic(spark, d):
    return memory.by_topic(_memories(spark, d), "t1").select("memory_id", "title", "topic_key")


@query(f"WITH {_MEM} SELECT memory_id, title, project FROM memories WHERE NOT deleted AND (title ILIKE '%click%' OR content ILIKE '%click%') AND memory_type = 'decision' ORDER BY updated DESC, memory_id DESC LIMIT 20")
def mem_text_search(spark, d):
    return memory.text_search(_memories(spark, d), "CLICK", 20, memory_type="decision").select("memory_id", "title", "project")


@query(f"WITH {_MEM} SELECT memory_id, title, CASE WHEN length(content) > 30 THEN content[1:30] || '...' ELSE content END AS preview FROM memories WHERE NOT deleted ORDER BY created DESC, memory_id DESC LIMIT 20")
def mem_recent(spark, d):
    return memory.recent(_memories(spark, d)).select("memory_id", "title", fn.preview(F.col("content"), 30).alias("preview"))


@query(f"WITH {_MEM} SELECT memory_id, deleted OR memory_id % 10 = 3 AS deleted FROM memories")
def mem_soft_delete(spark, d):
    m = _memories(spark, d)
    return memory.soft_delete(m, m.where("memory_id % 10 = 3")).select("memory_id", "deleted")


@query(f"WITH {_MEM} SELECT memory_id, CASE WHEN memory_id % 7 = 0 THEN 'new ' || title ELSE title END AS title, CASE WHEN memory_id % 14 = 0 THEN 'note' ELSE memory_type END AS memory_type, CASE WHEN memory_id % 7 = 0 THEN 2 ELSE 1 END::INT AS revision FROM memories")
def mem_partial_update(spark, d):
    m = _memories(spark, d)
    new = m.where("memory_id % 7 = 0").select("memory_id", F.concat(F.lit("new "), "title").alias("title"), F.lit(None).cast("string").alias("content"), F.when(F.col("memory_id") % 14 == 0, "note").alias("memory_type"))
    return memory.partial_update(m, new).select("memory_id", "title", "memory_type", "revision")


@query(f"WITH {_MEM} SELECT memory_type, project, count(*) AS n FROM memories WHERE NOT deleted GROUP BY GROUPING SETS ((memory_type), (project), ())")
def mem_stats(spark, d):
    return memory.stats(_memories(spark, d))


@query(f"WITH {_MEM} SELECT memory_id, title, created FROM memories WHERE NOT deleted AND title ILIKE '%view%' ORDER BY created DESC, memory_id DESC LIMIT 20")
def mem_search_archived(spark, d):
    return memory.recent(_memories(spark, d).where(F.col("title").ilike("%view%"))).select("memory_id", "title", "created")


# index state and sessions


@query(f"WITH {INDEX_STATE} SELECT repo_path, branch, record, last_commit FROM index_state QUALIFY row_number() OVER (PARTITION BY repo_path, branch ORDER BY indexed_at DESC, record DESC) = 1")
def idx_last(spark, d):
    return index_state.last_records(p.index_state(spark, d)).select("repo_path", "branch", "record", "last_commit")


@query(f"""WITH {FILES}, k AS (SELECT repo, branch, file, sha256(content || CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE '' END)[1:16] AS h FROM files WHERE doc_id % 3 <> 2
    QUALIFY row_number() OVER (PARTITION BY repo, branch, file ORDER BY doc_id DESC) = 1)
SELECT f.doc_id, f.file, k.h AS known_hash FROM files f LEFT JOIN k USING (repo, branch, file) WHERE sha256(f.content)[1:16] IS DISTINCT FROM k.h""")
def idx_changed_files(spark, d):
    f = p.files(spark, d).withColumn("content_hash", fn.content_hash(F.col("content")))
    old = f.where("doc_id % 3 <> 2").withColumn("content_hash", fn.content_hash(F.concat("content", F.when(F.col("doc_id") % 5 == 0, "x").otherwise(""))))
    known = old.groupBy("repo", "branch", "file").agg(F.max_by("content_hash", "doc_id").alias("content_hash"))
    return index_state.changed_files(f, known).select("doc_id", "file", "known_hash")


_BASE = "base AS (SELECT 'b' || n_nationkey AS branch, 'b' || (n_nationkey // 2) AS base_branch FROM nation)"


@query(f"""WITH RECURSIVE {_BASE}, c(branch, ancestor, depth, seen) AS (SELECT branch, branch, 0, [branch] FROM base
    UNION ALL SELECT c.branch, b.base_branch, depth + 1, list_append(seen, b.base_branch) FROM c JOIN base b ON b.branch = c.ancestor WHERE NOT list_contains(seen, b.base_branch))
SELECT branch, ancestor, depth FROM c""")
def idx_lineage(spark, d):
    base = p.table(spark, d, "nation").select(F.format_string("b%d", "n_nationkey").alias("branch"), F.format_string("b%d", F.floor(F.col("n_nationkey") / 2).cast("int")).alias("base_branch"))
    return index_state.lineage(base)


_NORMAL = INDEX_STATE + """, clean AS (SELECT DISTINCT repo_path, branch FROM index_state WHERE NOT ends_with(repo_path, '/')), normal AS (SELECT * FROM index_state WHERE NOT ends_with(repo_path, '/')
    UNION ALL SELECT * REPLACE (rtrim(repo_path, '/') AS repo_path) FROM index_state s WHERE ends_with(repo_path, '/') AND NOT EXISTS (SELECT 1 FROM clean c WHERE c.repo_path = rtrim(s.repo_path, '/') AND c.branch = s.branch)),
status AS (SELECT regexp_extract(repo_path, '[^/]*$') AS repo, branch, last_commit, symbol_count, indexed_at, 'indexed' AS status FROM normal QUALIFY row_number() OVER (PARTITION BY repo_path, branch ORDER BY indexed_at DESC, record DESC) = 1)"""


@query(f"WITH {_NORMAL} SELECT repo_path, branch, record FROM normal")
def idx_normalize_paths(spark, d):
    return index_state.normalize_paths(p.index_state(spark, d)).select("repo_path", "branch", "record")


@query(f"WITH {_NORMAL} SELECT * FROM status")
def idx_status(spark, d):
    return index_state.status(index_state.normalize_paths(p.index_state(spark, d)))


@query(f"WITH {_NORMAL} SELECT * FROM status WHERE repo = 'c7' AND branch = '1-URGENT'")
def idx_branch_context(spark, d):
    return index_state.status(index_state.normalize_paths(p.index_state(spark, d)), "c7", "1-URGENT")


@query(f"WITH {_NORMAL} SELECT 'index' AS type, repo, branch, indexed_at AS timestamp, 'Indexed ' || symbol_count || ' symbols at ' || last_commit[1:8] AS summary FROM status ORDER BY timestamp DESC, repo, branch LIMIT 50")
def history_index_events(spark, d):
    return index_state.history(index_state.normalize_paths(p.index_state(spark, d)))


def _sessions(spark, d):
    return p.table(spark, d, "events").select(F.col("user_id").alias("owner"), F.col("event_id").alias("session"), F.col("ts").alias("started"))


@query("SELECT user_id AS owner, event_id AS session, ts AS started, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ended FROM events")
def session_close_active(spark, d):
    return index_state.close_active(_sessions(spark, d), ["owner"])


@query("SELECT user_id AS owner, event_id AS session, ts AS started FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def session_recent(spark, d):
    return index_state.recent_sessions(_sessions(spark, d))


@query("SELECT event_id, coalesce(event_type, '') AS event_type, coalesce(props, '{}') AS metadata, json_extract_string(props, '$.k') AS k FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def session_recent_events(spark, d):
    return index_state.recent_events(p.table(spark, d, "events"))


# sync

_PLAN = STORES + """, planned AS (SELECT coalesce(l.id, s.id) AS id, l.branch, l.id IS NOT NULL AND s.id IS NOT NULL AND l.content_hash <> s.content_hash AS conflict,
    CASE WHEN s.id IS NULL THEN 'push' WHEN l.id IS NULL THEN 'pull' WHEN l.content_hash <> s.content_hash AND s.indexed_at > l.indexed_at THEN 'pull' WHEN l.content_hash <> s.content_hash THEN 'push' ELSE 'none' END AS action
    FROM local l FULL JOIN shared s ON l.id = s.id)"""


@query(f"WITH {STORES} SELECT branch, count(*) AS points FROM local WHERE repo = 'src3' GROUP BY branch")
def sync_push_counts(spark, d):
    return sync.branch_counts(p.stores(spark, d)[0], "src3")


@query(f"WITH {STORES} SELECT branch, count(*) AS points FROM shared WHERE repo = 'src3' GROUP BY branch")
def sync_pull_counts(spark, d):
    return sync.branch_counts(p.stores(spark, d)[1], "src3")


@query(f"WITH {_PLAN} SELECT * FROM planned")
def sync_plan(spark, d):
    return sync.plan(*p.stores(spark, d))


@query(f"WITH {_PLAN} SELECT count(*) FILTER (action = 'push') AS pushed, count(*) FILTER (action = 'pull') AS pulled, count(*) FILTER (conflict) AS conflicts FROM planned")
def sync_summary(spark, d):
    return sync.summary(sync.plan(*p.stores(spark, d)))


@query(f"WITH {_PLAN}, l2 AS (SELECT id, content_hash FROM local WHERE id NOT IN (SELECT id FROM planned WHERE action = 'pull') UNION ALL SELECT id, content_hash FROM shared WHERE id IN (SELECT id FROM planned WHERE action = 'pull')) SELECT * FROM l2")
def sync_apply(spark, d):
    return sync.apply(*p.stores(spark, d))[0].select("id", "content_hash")


@query("SELECT DISTINCT source AS repo, 'code_' || sha256(source)[1:16] AS collection FROM documents")
def sync_collection_name(spark, d):
    return p.table(spark, d, "documents").select(F.col("source").alias("repo"), fn.collection_name(F.col("source")).alias("collection")).distinct()


# context


@query(f"WITH {FILES}, c AS (SELECT repo, doc_id, (strlen(content) // 4)::BIGINT AS cost FROM files), u AS (SELECT *, sum(cost) OVER (PARTITION BY repo ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM c) SELECT repo, doc_id, cost, used FROM u WHERE used <= 4096")
def ctx_pack_prefix(spark, d):
    f = p.files(spark, d).select("repo", "doc_id", fn.context_cost(F.col("content")).alias("cost"))
    return context.pack_prefix(f, ["repo"], ["doc_id"], "cost", context.BUDGET)


@query(f"""WITH RECURSIVE {FILES}, c AS (SELECT repo, doc_id, (strlen(content) // 4)::BIGINT AS cost, row_number() OVER (PARTITION BY repo ORDER BY doc_id) AS i FROM files),
g(repo, i, doc_id, cost, used, keep) AS (SELECT repo, i, doc_id, cost, CASE WHEN cost <= 4096 THEN cost ELSE 0 END, cost <= 4096 FROM c WHERE i = 1
    UNION ALL SELECT c.repo, c.i, c.doc_id, c.cost, CASE WHEN used + c.cost <= 4096 THEN used + c.cost ELSE used END, used + c.cost <= 4096 FROM g JOIN c ON c.repo = g.repo AND c.i = g.i + 1)
SELECT repo, doc_id, cost FROM g WHERE keep""")
def ctx_pack_greedy(spark, d):
    f = p.files(spark, d).select("repo", "doc_id", fn.context_cost(F.col("content")).alias("cost"))
    return context.pack_greedy(f, ["repo"], "doc_id", "cost", context.BUDGET)


@query("""WITH w AS (SELECT page_id, trim(unnest(regexp_split_to_array(replace(url, '?', ' ') || ' (see src/app' || page_id || '.ts, or "x.service".)', '\\s+')), ',.;:()[]{}"''`') AS hint FROM pages)
SELECT page_id, hint FROM w WHERE regexp_matches(hint, '\\.(ts|js|java|html|css|service|component|interface)$') UNION ALL SELECT page_id, hint FROM w WHERE contains(hint, '/') AND strlen(hint) > 3""")
def ctx_file_hints(spark, d):
    text = F.concat(F.replace("url", F.lit("?"), F.lit(" ")), F.lit(" (see src/app"), F.col("page_id").cast("string"), F.lit('.ts, or "x.service".)'))
    return context.file_hints(p.table(spark, d, "pages").select("page_id", text.alias("text")), ["page_id"], "text")


@query(f"""WITH RECURSIVE {VECTORS}, near AS (SELECT row_number() OVER (ORDER BY score, id) AS pos, text, score
    FROM (SELECT id, text[1:300] || ' see src/app' || (vec_id % 7) || '.ts.' AS text, {_L2} AS score FROM vectors, probe WHERE branch = 'main' ORDER BY score, id LIMIT 5)),
m AS (SELECT pos, text, '// [memory] ' || text || chr(10) || chr(10) AS note FROM near WHERE score < 1.5 AND text <> ''),
w AS (SELECT pos AS memory, unnest(generate_series(1, len(l))) AS ord, trim(unnest(l), ',.;:()[]{{}}"''`') AS hint FROM (SELECT pos, regexp_split_to_array(text, '\\s+') AS l FROM m)),
hints AS (SELECT memory, ord, hint, false AS slash FROM w WHERE regexp_matches(hint, '\\.(ts|js|java|html|css|service|component|interface)$') UNION ALL SELECT memory, ord, hint, true FROM w WHERE contains(hint, '/') AND strlen(hint) > 3),
cells AS (SELECT hint, ('0x' || h[1:4])::INT % 64 AS i, sum(CASE WHEN h[5:5] < '8' THEN 1.0 ELSE -1.0 END)::DOUBLE AS x
    FROM (SELECT hint, sha1(unnest(list_filter(regexp_split_to_array(lower(hint), '[^a-z0-9]+'), lambda x: x <> ''))) AS h FROM (SELECT DISTINCT hint FROM hints)) GROUP BY ALL),
norms AS (SELECT hint, sqrt(sum(x * x)) AS n FROM cells GROUP BY hint),
embedded AS (SELECT d.hint, list(CASE WHEN n > 0 THEN coalesce(x, 0) / n ELSE 0 END ORDER BY r.i) AS q FROM (SELECT DISTINCT hint FROM hints) d CROSS JOIN range(64) AS r(i) LEFT JOIN cells c ON c.hint = d.hint AND c.i = r.i LEFT JOIN norms n ON n.hint = d.hint GROUP BY d.hint),
found AS (SELECT hint, id, file, start_line, text[1:500] AS text, power(list_distance(vector::DOUBLE[], embedded.q::DOUBLE[]), 2) AS score FROM vectors, embedded WHERE branch = 'develop' QUALIFY row_number() OVER (PARTITION BY hint ORDER BY score, id) <= 3),
one AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY hint, file, start_line ORDER BY score, id) = 1),
hinted AS (SELECT row_number() OVER (ORDER BY memory, ord, slash, score, id) AS pos, '// ' || file || ':' || start_line || chr(10) || text || chr(10) || chr(10) AS note FROM hints JOIN one USING (hint)),
both_ AS (SELECT 'memory' AS part, pos, note, 0 AS o FROM m UNION ALL SELECT 'hint', pos, note, 1 FROM hinted),
mc AS (SELECT row_number() OVER (ORDER BY o, pos) AS i, part, pos, note, (strlen(note) // 4)::BIGINT AS cost FROM both_),
g(i, part, pos, note, cost, used, keep) AS (SELECT 0, '', 0, '', 0::BIGINT, 0::BIGINT, false UNION ALL
    SELECT mc.i, mc.part, mc.pos, mc.note, mc.cost, CASE WHEN used + mc.cost <= 4096 THEN used + mc.cost ELSE used END, used + mc.cost <= 4096 FROM g JOIN mc ON mc.i = g.i + 1),
there AS (SELECT coalesce(string_agg(note, '' ORDER BY i), '') AS t, coalesce(sum(cost), 0) AS before FROM g WHERE keep),
h AS (SELECT row_number() OVER (ORDER BY score, id) AS pos, file, '// ' || file || ':' || start_line || chr(10) || text[1:500] || chr(10) || chr(10) AS note
    FROM (SELECT id, file, start_line, text, {_L2} AS score FROM vectors, probe WHERE branch = 'develop' ORDER BY score, id LIMIT 30)),
u AS (SELECT pos, note, (strlen(note) // 4)::BIGINT AS cost, (sum(strlen(note) // 4) OVER (ORDER BY pos))::BIGINT + before AS used FROM h, there WHERE NOT contains(t, '// ' || file || ':'))
SELECT part, pos, note, cost FROM g WHERE keep UNION ALL SELECT 'code', pos, note, cost FROM u WHERE used <= 4096""")
def build_context(spark, d):
    """All three parts: memories, chunks of the files that they name, found by the hashing embedder, and hits."""
    from pyspark.sql import Window

    v, q = p.vectors(spark, d), p.probe(spark, d)
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("score", "id"))  # over a top-k result
    named = F.concat(F.substring("text", 1, 300), F.lit(" see src/app"), (F.col("vec_id") % 7).cast("string"), F.lit(".ts."))
    m = cut(vector.nearest(v.where("branch = 'main'").withColumn("text", named), q, 5).withColumn("pos", rank))
    h = vector.nearest(v.where("branch = 'develop'"), q, 30).withColumn("pos", rank).withColumn("text", F.substring("text", 1, 500))
    embed = lambda hints: embedding.hash_embed(hints, ["hint"], "hint").withColumnRenamed("vector", "q")
    return context.build_context(m, h, hinted=context.hint_hits(m, v.where("branch = 'develop'"), embed))


# chunking: the lines of each document are symbols of a class and around it


def _symbols(spark, d):
    f = p.files(spark, d).select("doc_id", F.concat("file", F.lit("#"), F.col("doc_id").cast("string")).alias("file"), "language", F.posexplode(F.split("content", "\n", -1)).alias("ord", "code"))
    k = F.col("ord") % 4
    kind = F.when(F.col("ord") == 0, "class").when(k == 1, "method").when(k == 2, "function").when(k == 3, "constant").otherwise("method")
    name = F.concat(F.when(F.col("ord") == 0, "K").otherwise("s"), F.col("ord").cast("string"))
    return f.select("file", "ord", name.alias("name"), kind.alias("kind"), F.when((F.col("ord") > 0) & ((k == 1) | (k == 0)), "K0").alias("parent"), F.concat(kind, F.lit(" "), name).alias("signature"),
                    F.when(F.col("ord") == 0, "doc").alias("docstring"), F.repeat("code", 1).alias("code"), (F.col("ord") + 1).alias("start_line"), (F.col("ord") + 1).alias("end_line"), "language")


_SYM = FILES + """, syms AS (SELECT file, ord, CASE WHEN ord = 0 THEN 'K' ELSE 's' END || ord AS name, kind, CASE WHEN ord > 0 AND ord % 4 IN (0, 1) THEN 'K0' END AS parent,
    kind || ' ' || CASE WHEN ord = 0 THEN 'K' ELSE 's' END || ord AS signature, code, (ord + 1)::INT AS start_line, (ord + 1)::INT AS end_line, language, (length(code) // 4) AS t
    FROM (SELECT *, CASE WHEN ord = 0 THEN 'class' WHEN ord % 4 = 2 THEN 'function' WHEN ord % 4 = 3 THEN 'constant' ELSE 'method' END AS kind
        FROM (SELECT file || '#' || doc_id AS file, language, unnest(string_split(content, chr(10))) AS code, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS ord FROM files)))"""
_SUMMARY = """summaries AS (SELECT file, 'file' AS level, NULL::VARCHAR AS symbol, NULL::VARCHAR AS symbol_type, 1::INT AS start_line, max(end_line)::INT AS end_line,
    '# File: ' || file || chr(10) || '# Language: ' || any_value(language) || chr(10) || chr(10) || 'import os' || chr(10) || 'from m import a, b' || chr(10) || chr(10)
    || string_agg('  ' || kind || ': ' || signature, chr(10) ORDER BY ord) FILTER (parent IS NULL) AS text FROM syms GROUP BY file)"""
_CLASS = """classes AS (SELECT file, 'class' AS level, 'K0' AS symbol, 'class' AS symbol_type, 1::INT AS start_line, 1::INT AS end_line,
    '# class K0' || chr(10) || chr(10) || '\"\"\"doc\"\"\"' || chr(10) || coalesce(chr(10) || string_agg('  ' || kind || ': ' || signature, chr(10) ORDER BY ord) FILTER (parent IS NOT NULL), '') AS text FROM syms GROUP BY file)"""
_HEAD = "'# ' || file || CASE WHEN parent IS NOT NULL THEN ' > ' || parent ELSE '' END"
_KEPT = f"""kept AS (SELECT file, 'function' AS level, name AS symbol, kind AS symbol_type, start_line, end_line, {_HEAD} || ' > ' || name || chr(10) || code AS text FROM syms
    WHERE ord > 0 AND t >= 64)"""
_MERGED = f"""merged AS (SELECT file, 'function' AS level, NULL::VARCHAR AS symbol, 'grouped' AS symbol_type, min(start_line)::INT AS start_line, max(end_line)::INT AS end_line,
    {_HEAD} || ' > (grouped small symbols)' || chr(10) || string_agg(chr(10) || '# ' || kind || ': ' || name || chr(10) || code, chr(10) ORDER BY ord) AS text FROM syms WHERE ord > 0 AND t < 64 GROUP BY file, parent)"""


def _imports(spark, d):
    f = _symbols(spark, d).select("file").distinct()
    rows = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(m).alias("module"), F.lit(None).cast("string").alias("alias"), n.alias("names")) for i, m, n in ((0, "os", F.array().cast("array<string>")), (1, "m", F.array(F.lit("a"), F.lit("b"))))])
    return f.select("file", F.inline(rows))


def _own_files(spark, d):
    return _symbols(spark, d).select("file", "language").distinct()


@query(f"WITH {_SYM}, {_SUMMARY} SELECT * FROM summaries")
def chunk_file_summary(spark, d):
    return chunking.file_summaries(_own_files(spark, d), _symbols(spark, d), _imports(spark, d))


@query(f"WITH {_SYM}, {_CLASS} SELECT * FROM classes")
def chunk_class_summary(spark, d):
    return chunking.class_summaries(_symbols(spark, d))


@query(f"WITH {_SYM} SELECT file, 'function' AS level, name AS symbol, kind AS symbol_type, start_line, end_line, {_HEAD} || ' > ' || name || chr(10) || code AS text FROM syms")
def chunk_symbol(spark, d):
    return chunking.symbol_chunks(_symbols(spark, d))


@query(f"WITH {_SYM}, {_MERGED} SELECT * FROM merged")
def chunk_merge_small(spark, d):
    s = _symbols(spark, d)
    return chunking.merge_small(s.where((F.col("ord") > 0) & (fn.token_estimate(F.col("code")) < chunking.MIN_TOKENS)))


@query(f"WITH {_SYM}, {_SUMMARY}, {_CLASS}, {_KEPT}, {_MERGED}, u AS (SELECT * FROM summaries UNION ALL SELECT * FROM classes UNION ALL SELECT * FROM kept UNION ALL SELECT * FROM merged) SELECT *, sha256(text)[1:16] AS content_hash FROM u")
def chunk_all(spark, d):
    return chunking.chunk(_own_files(spark, d), _symbols(spark, d).drop("language"), _imports(spark, d))


@query(f"""WITH RECURSIVE {FILES}, d AS (SELECT file || '#' || doc_id AS file, string_split(content, chr(10)) AS l, greatest(10, len(string_split(content, chr(10))) // greatest(1, (length(content) // 4) // 512)) AS target FROM files WHERE contains(content, chr(10))),
r(file, k, s, e) AS (SELECT file, -1, 0, 0 FROM d UNION ALL
    SELECT r.file, k + 1, r.e, coalesce(CASE WHEN r.e + target < len(l) THEN list_filter(list_transform(generate_series(0, least(5, target // 3) - 1), lambda o:
        CASE WHEN r.e + target + o < len(l) AND trim(l[r.e + target + o + 1]) = '' THEN r.e + target + o + 1 WHEN target - o > 0 AND trim(l[r.e + target - o + 1]) = '' THEN r.e + target - o + 1 END), lambda x: x IS NOT NULL)[1] END, least(r.e + target, len(l)))
    FROM r JOIN d USING (file) WHERE r.e < len(l))
SELECT file, 'block' AS level, 'doc[' || k || ']' AS symbol, 'function' AS symbol_type, (s + 1)::INT AS start_line, e::INT AS end_line,
    '# ' || file || ' > doc' || CASE WHEN k = 0 THEN chr(10) ELSE ' (part ' || (k + 1) || ')' || chr(10) || l[1] || chr(10) || '# ...' || chr(10) END || array_to_string(l[s + 1:e], chr(10)) AS text FROM r JOIN d USING (file) WHERE k >= 0
UNION ALL SELECT file || '#' || doc_id, 'function', 'doc', 'function', 1, 1, '# ' || file || '#' || doc_id || ' > doc' || chr(10) || content FROM files WHERE NOT contains(content, chr(10))""")
def chunk_split_large(spark, d):
    none = F.lit(None).cast("string")
    whole = p.files(spark, d).select(F.concat("file", F.lit("#"), F.col("doc_id").cast("string")).alias("file"), F.lit(0).alias("ord"), F.lit("doc").alias("name"), F.lit("function").alias("kind"), none.alias("parent"),
                                     F.lit("function doc").alias("signature"), none.alias("docstring"), F.col("content").alias("code"), F.lit(1).alias("start_line"), F.size(F.split("content", "\n", -1)).alias("end_line"))
    return chunking.split_large(whole)


# parsing


@query("""SELECT lang || '/f' || (doc_id % 250) || '.md' AS file, 0::INT AS ord, 'f' || (doc_id % 250) AS name, 'file' AS kind, 'file f' || (doc_id % 250) || '.md' AS signature, text AS code, 1::INT AS start_line,
    len(string_split(text, chr(10)))::INT AS end_line, strlen(text)::INT AS end_byte FROM documents WHERE regexp_matches(text, '\\S')""")
def parse_raw_text(spark, d):
    return parsing.raw_symbols(p.files(spark, d)).drop("parent", "docstring")


_SOURCES = {
    "python": "import os\nfrom m%d import a, b as c\n\nclass K%d(Base):\n    \"\"\"Doc.\"\"\"\n    def run(self, x: int) -> str:\n        return helper(x)\n    def _hid(self):\n        self.run(1)\n\ndef helper(v):\n    return str(v)\n",
    "go": "package m\n\nimport \"fmt%d\"\n\ntype K%d struct {\n\tA int\n}\n\nfunc (k *K) Run(x int) {\n\thelper(x)\n}\n\nfunc helper(v int) {\n\tfmt.Println(v)\n}\n",
    "typescript": "import { a, b } from './m%d';\n\nexport class K%d {\n  run(x) {\n    return helper(x);\n  }\n}\n\nexport function helper(v) {\n  return v;\n}\n",
    "java": "import a.m%d;\n\npublic class K%d {\n    public int run(int x) {\n        return helper(x);\n    }\n}\n",
    "broken": "",
}


def _sources(spark, d):
    """A source file of each language for every part; every eleventh Python file does not parse."""
    t = spread(p.table(spark, d, "part").select("p_partkey"), "p_partkey")
    rows = F.array(*[F.struct(F.lit(k).alias("language"), F.lit(v).alias("template")) for k, v in _SOURCES.items() if v])
    t = t.select("p_partkey", F.inline(rows))
    n = F.col("p_partkey").cast("string")
    content = F.replace("template", F.lit("%d"), n)
    broken = (F.col("language") == "python") & (F.col("p_partkey") % 11 == 0)
    return t.select(F.concat(F.lit("src/"), "language", F.lit("/f"), n).alias("file"), "language", F.when(broken, F.concat(content, F.lit("def (\n"))).otherwise(content).alias("content"))


_LANGS = "langs AS (SELECT p_partkey, unnest(['python','go','typescript','java']) AS language FROM part), ok AS (SELECT *, 'src/' || language || '/f' || p_partkey AS file FROM langs WHERE NOT (language = 'python' AND p_partkey % 11 = 0))"


@query(f"""WITH {_LANGS}, s(language, ord, name, kind, parent, start_line, end_line) AS (VALUES ('python', 0, 'K%', 'class', NULL, 4, 9), ('python', 1, 'run', 'method', 'K%', 6, 7), ('python', 2, '_hid', 'method', 'K%', 8, 9), ('python', 3, 'helper', 'function', NULL, 11, 12),
    ('go', 0, 'K%', 'struct', NULL, 5, 7), ('go', 1, 'Run', 'method', 'K', 9, 11), ('go', 2, 'helper', 'function', NULL, 13, 15), ('typescript', 0, 'K%', 'class', NULL, 3, 7), ('typescript', 1, 'run', 'method', 'K%', 4, 6), ('typescript', 2, 'helper', 'function', NULL, 9, 11),
    ('java', 0, 'K%', 'class', NULL, 3, 7), ('java', 1, 'run', 'method', 'K%', 4, 6))
SELECT file, ord::INT AS ord, replace(name, '%', p_partkey::VARCHAR) AS name, kind, replace(parent, '%', p_partkey::VARCHAR) AS parent, start_line::INT AS start_line, end_line::INT AS end_line FROM ok JOIN s USING (language)""")
def parse_symbols(spark, d):
    return parsing.symbols_of(parsing.parse(_sources(spark, d), parts=("symbols",))).select("file", "ord", "name", "kind", "parent", "start_line", "end_line")


@query("SELECT 'src/python/f' || p_partkey AS file, CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE 4 END::INT AS symbols, CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE 2 END::INT AS imports, p_partkey % 11 = 0 AS failed FROM part")
def parse_python(spark, d):
    out = parsing.parse(_sources(spark, d).where("language = 'python'"), parts=("symbols", "imports"))
    return out.select("file", F.size("symbols").alias("symbols"), F.size("imports").alias("imports"), F.col("error").isNotNull().alias("failed"))


@query(f"""WITH {_LANGS}, i(language, ord, module, names, line) AS (VALUES ('python', 0, 'os', '', 1), ('python', 1, 'm%', 'a,b', 2), ('go', 0, 'fmt%', '', 3), ('typescript', 0, './m%', 'a,b', 1), ('java', 0, 'a.m%', '', 1))
SELECT file, ord::INT AS ord, replace(module, '%', p_partkey::VARCHAR) AS module, names, line::INT AS line FROM ok JOIN i USING (language)""")
def parse_imports(spark, d):
    return parsing.imports_of(parsing.parse(_sources(spark, d), parts=("imports",))).select("file", "ord", "module", F.array_join("names", ",").alias("names"), "line")


@query(f"""WITH {_LANGS}, c(language, caller, callee, line) AS (VALUES ('python', 'run', 'helper', 7), ('python', '_hid', 'run', 9), ('python', 'helper', 'str', 12), ('go', 'Run', 'helper', 10), ('go', 'helper', 'Println', 14), ('typescript', 'run', 'helper', 5), ('java', 'run', 'helper', 5))
SELECT file || '::' || caller AS source, callee AS target, 'calls' AS kind, file AS source_file, line::INT AS line FROM ok JOIN c USING (language)""")
def parse_calls(spark, d):
    return parsing.call_edges(parsing.parse(_sources(spark, d), parts=("calls",)))


@query(f"WITH {_LANGS} SELECT file, 'K' || p_partkey || ',helper' AS exports FROM ok WHERE language = 'typescript'")
def parse_exports(spark, d):
    out = parsing.parse(_sources(spark, d).where("language = 'typescript'"), parts=("exports",))
    return out.select("file", F.array_join("exports", ",").alias("exports"))


@query(f"""WITH {_LANGS}, i(language, module, line) AS (VALUES ('python', 'os', 1), ('python', 'm%', 2), ('go', 'fmt%', 3), ('typescript', './m%', 1), ('java', 'a.m%', 1))
SELECT file || '::<module>' AS source, replace(module, '%', p_partkey::VARCHAR) AS target, 'imports' AS kind, file AS source_file, line::INT AS line FROM ok JOIN i USING (language)""")
def edges_imports(spark, d):
    return parsing.import_edges(parsing.imports_of(parsing.parse(_sources(spark, d), parts=("imports",))))


@query("""WITH t(language, kind, parsed) AS (VALUES
    ('c', 'ast', false), ('c_sharp', 'ast', false), ('cpp', 'ast', false), ('css', 'raw', false), ('dart', 'ast', false), ('elixir', 'ast', false), ('go', 'ast', true),
    ('graphql', 'raw', false), ('html', 'raw', false), ('java', 'ast', true), ('javascript', 'ast', true), ('json', 'raw', false), ('kotlin', 'ast', false),
    ('less', 'raw', false), ('lua', 'ast', false), ('markdown', 'raw', false), ('php', 'ast', true), ('protobuf', 'raw', false), ('python', 'ast', true),
    ('ruby', 'ast', false), ('rust', 'ast', true), ('sass', 'raw', false), ('scala', 'ast', false), ('scss', 'raw', false), ('sql', 'raw', false),
    ('swift', 'ast', false), ('typescript', 'ast', true), ('xml', 'raw', false), ('yaml', 'raw', false), ('zig', 'ast', false)),
p AS (SELECT page_id, (['c', 'php', 'python', 'lua', 'yaml', 'klingon', 'go', NULL])[(page_id % 8 + 1)::INT] AS language FROM pages)
SELECT page_id, p.language, coalesce(kind, 'none') AS kind, coalesce(parsed, false) AS parsed FROM p LEFT JOIN t ON t.language = p.language""")
def parse_support_matrix(spark, d):
    """How the language of each file is read: parsed, as raw text, or not at all."""
    name = F.element_at(F.array(*[F.lit(x) for x in ("c", "php", "python", "lua", "yaml", "klingon", "go", None)]), (F.col("page_id") % 8 + 1).cast("int"))
    files = p.table(spark, d, "pages").select("page_id", name.alias("language"))
    out = files.join(F.broadcast(support_matrix(spark)), "language", "left")  # thirty rows
    return out.select("page_id", "language", F.coalesce("kind", F.lit("none")).alias("kind"), F.coalesce("parsed", F.lit(False)).alias("parsed"))


# embedding


@query("""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM documents),
c AS (SELECT doc_id, ('0x' || h[1:4])::INT % 64 AS i, sum(CASE WHEN h[5:5] < '8' THEN 1.0 ELSE -1.0 END)::DOUBLE AS x FROM (SELECT doc_id, sha1(w) AS h FROM w) GROUP BY ALL),
n AS (SELECT doc_id, sqrt(sum(x * x)) AS n FROM c GROUP BY doc_id)
SELECT d.doc_id, round(coalesce(max(x) FILTER (i = 0), 0) / max(CASE WHEN n > 0 THEN n ELSE 1 END), 4) AS v0, round(coalesce(max(x) FILTER (i = 63), 0) / max(CASE WHEN n > 0 THEN n ELSE 1 END), 4) AS v63, 64::INT AS dimension
FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id""")
def embed_hash(spark, d):
    out = embedding.hash_embed(p.table(spark, d, "documents").select("doc_id", "text"), ["doc_id"], "text")
    return out.select("doc_id", F.round(F.coalesce(F.element_at("vector", 1), F.lit(0.0)), 4).alias("v0"), F.round(F.coalesce(F.element_at("vector", 64), F.lit(0.0)), 4).alias("v63"), F.size("vector").alias("dimension"))


@query("""WITH t(key, name, dimension, size_mb, cached) AS (VALUES ('minilm-l6', 'all-MiniLM-L6-v2', 384::INT, 22::INT, false), ('minilm-l12', 'all-MiniLM-L12-v2', 384::INT, 33::INT, false),
    ('bge-small', 'BAAI/bge-small-en-v1.5', 384::INT, 33::INT, false), ('bge-base', 'BAAI/bge-base-en-v1.5', 768::INT, 110::INT, false)),
e AS (SELECT vec_id, (['minilm-l6', 'bge-base', 'BAAI/bge-small-en-v1.5', 'none'])[(vec_id % 4 + 1)::INT] AS model, len(embedding) * (1 + 5 * (vec_id % 3 = 0)::INT) AS size FROM embeddings)
SELECT vec_id, model, t.key AS key, t.dimension AS dimension, coalesce(t.dimension = size, false) AS fits FROM e LEFT JOIN t ON t.key = model OR t.name = model""")
def model_list(spark, d):
    """The model of each vector by key or name, and whether the vector has its dimension."""
    model = F.element_at(F.array(*[F.lit(x) for x in ("minilm-l6", "bge-base", "BAAI/bge-small-en-v1.5", "none")]), (F.col("vec_id") % 4 + 1).cast("int"))
    e = p.table(spark, d, "embeddings").select("vec_id", model.alias("model"), (F.size("embedding") * (1 + 5 * (F.col("vec_id") % 3 == 0).cast("int"))).alias("size"))
    known = embedding.model_list(spark)
    named = known.select(F.explode(F.array("key", "name")).alias("model"), "key", "dimension")
    return e.join(F.broadcast(named), "model", "left").select("vec_id", "model", "key", "dimension", F.coalesce(F.col("dimension") == F.col("size"), F.lit(False)).alias("fits"))


# indexing


@query("SELECT count(*) - count(*) FILTER (p_partkey % 11 = 0) + 3 * count(*) AS file_count, (sum(CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE 4 END) + 8 * count(*))::BIGINT AS symbol_count, 15 * count(*) - 4 * count(*) FILTER (p_partkey % 11 = 0) AS chunk_count FROM part")
def index_repo_summary(spark, d):
    done = indexing.index(_sources(spark, d))
    return indexing.summary(done["chunks"], done["records"])


@query("SELECT 'src/python/f' || p_partkey AS file, 'SyntaxError' AS error FROM part WHERE p_partkey % 11 = 0")
def index_errors(spark, d):
    return indexing.index(_sources(spark, d), keep=False)["errors"].select("file", F.substring_index("error", ":", 1).alias("error"))


@query(f"WITH {FILES}, k AS (SELECT file || '#' || doc_id AS file, sha256(content || CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE '' END)[1:16] AS h FROM files WHERE doc_id % 3 <> 2) SELECT f.doc_id, f.file FROM (SELECT doc_id, file || '#' || doc_id AS file, content FROM files) f LEFT JOIN k USING (file) WHERE sha256(content)[1:16] IS DISTINCT FROM h")
def index_skip_unchanged(spark, d):
    f = p.files(spark, d).select("doc_id", F.concat("file", F.lit("#"), F.col("doc_id").cast("string")).alias("file"), "content")
    known = f.where("doc_id % 3 <> 2").select("file", fn.content_hash(F.concat("content", F.when(F.col("doc_id") % 5 == 0, "x").otherwise(""))).alias("content_hash"))
    return indexing.needs_work(f, known).select("doc_id", "file")


@query("SELECT CASE p_partkey % 4 WHEN 1 THEN 'new/' || p_partkey ELSE 'f/' || p_partkey END AS file, p_brand AS content_hash FROM part WHERE p_partkey % 4 <> 0")
def index_apply_changes(spark, d):
    t = p.table(spark, d, "part")
    name = F.concat(F.lit("f/"), F.col("p_partkey").cast("string"))
    state = t.select(name.alias("file"), F.col("p_brand").alias("content_hash"))
    status = F.when(F.col("p_partkey") % 4 == 0, "deleted").when(F.col("p_partkey") % 4 == 1, "renamed").otherwise("modified")
    path = F.when(status == "renamed", F.concat(F.lit("new/"), F.col("p_partkey").cast("string"))).otherwise(name)
    return indexing.apply_changes(state, t.select(status.alias("status"), path.alias("path"), F.when(status == "renamed", name).alias("old_path")))


# streams


def _watch(spark, d):
    return p.table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.concat("event_type", F.lit("/"), (F.col("event_id") % 5).cast("string")).alias("path"))


@query("""WITH e AS (SELECT user_id, ts, event_type || '/' || (event_id % 5) AS path, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e)
SELECT user_id, epoch_us(min(ts)) AS started, epoch_us(max(ts) + INTERVAL 6 HOUR) AS fires, string_agg(DISTINCT path, ',' ORDER BY path) AS paths, count(*) AS events FROM s GROUP BY user_id, g""")
def stream_debounce(spark, d):
    """The events as a stream of four micro-batches, up to an hour out of order."""
    own = _watch(spark, d).withColumn("comes", F.unix_micros("ts") + F.pmod(F.xxhash64("path", "ts"), F.lit(3_600_000_000)))
    stream = streams.replay(own, checkpoint_folder(spark), F.col("comes"), 4)
    out = streams.run_debounce_stream(stream, ["user_id"], "6 hours", "1 hour", checkpoint_folder(spark))
    return out.select("user_id", F.unix_micros("started").alias("started"), F.unix_micros("fires").alias("fires"), F.array_join("paths", ",").alias("paths"), "events")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 10")
def retry_bounded_queue(spark, d):
    log = p.table(spark, d, "events").select("user_id", "event_id")
    return streams.bounded_queue(log, ["user_id"], "event_id", 10)


@query("WITH f AS (SELECT user_id, min(event_id) AS first FROM events WHERE value > 95 GROUP BY user_id) SELECT e.user_id, e.event_id, CASE WHEN first IS NULL OR e.event_id < first THEN 'done' ELSE 'waiting' END AS state FROM events e LEFT JOIN f ON f.user_id = e.user_id")
def retry_flush(spark, d):
    queue = p.table(spark, d, "events").select("user_id", "event_id", (F.col("value") > 95).alias("fails"))
    return streams.flush(queue, ["user_id"], "event_id").select("user_id", "event_id", "state")


@query("""SELECT store, event_id, CASE WHEN healthy THEN 'up' ELSE 'down' END AS transition FROM (SELECT user_id AS store, event_id, value >= 50 AS healthy, coalesce(lag(value >= 50) OVER (PARTITION BY user_id ORDER BY ts, event_id), true) AS b FROM events) WHERE b <> healthy""")
def health_transitions(spark, d):
    return streams.transitions(p.health(spark, d), ["store"], ["ts", "event_id"]).select("store", "event_id", "transition")
