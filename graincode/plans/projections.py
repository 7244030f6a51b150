"""The engine's tables as projections of the provided ones, in Spark and in SQL.

The SQL texts are the same projections for the oracles; both are defined here so that a query and its oracle can't drift apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graincode.functions.scalars import content_hash, deterministic_id


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, repo, branch, file, content, language: several branches share file names."""
    branch = F.element_at(F.array(F.lit("main"), F.lit("develop"), F.lit("feature")), (F.col("doc_id") % 3 + 1).cast("int"))
    file = F.concat("lang", F.lit("/f"), (F.col("doc_id") % 250).cast("string"), F.lit(".md"))
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("repo"), branch.alias("branch"), file.alias("file"), F.col("text").alias("content"), F.col("lang").alias("language"))


FILES = """files AS (SELECT doc_id, source AS repo, (['main','develop','feature'])[(doc_id % 3 + 1)::INT] AS branch,
    lang || '/f' || (doc_id % 250) || '.md' AS file, text AS content, lang AS language FROM documents)"""

KINDS = ["function", "method", "class", "struct", "interface", "enum", "variable", "constant", "module", "grouped"]


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One point for each embedding with a document; symbol types by label, deletions marked on some."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    own = table(spark, sf_dir, "embeddings").join(files(spark, sf_dir), F.col("vec_id") == F.col("doc_id"))
    start = (F.col("vec_id") % 40 + 1).cast("int")
    return own.select(
        "vec_id",
        deterministic_id(F.col("repo"), F.col("branch"), F.col("file"), start).alias("id"),
        F.col("embedding").alias("vector"),
        F.col("content").alias("text"),
        "repo",
        "branch",
        "file",
        "language",
        F.concat(F.lit("sym"), F.col("label").cast("string")).alias("symbol"),
        F.element_at(kinds, F.col("label") + 1).alias("symbol_type"),
        start.alias("start_line"),
        (start + 10).cast("int").alias("end_line"),
        content_hash(F.col("content")).alias("content_hash"),
        (F.col("vec_id") % 11 == 0).alias("is_deletion"),
    )


VECTORS = (
    FILES
    + """, vectors AS (SELECT vec_id, sha256(repo || ':' || branch || ':' || file || ':' || (vec_id % 40 + 1))[1:32] AS id, embedding AS vector, content AS text,
    repo, branch, file, language, 'sym' || label AS symbol,
    (['function','method','class','struct','interface','enum','variable','constant','module','grouped'])[label + 1] AS symbol_type,
    (vec_id % 40 + 1)::INT AS start_line, (vec_id % 40 + 11)::INT AS end_line, sha256(content)[1:16] AS content_hash, vec_id % 11 = 0 AS is_deletion
    FROM embeddings JOIN files ON vec_id = doc_id), probe AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"""
)


def probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query vector: one row."""
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("q"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph edges from order lines, with the order in which they arrive."""
    li = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "calls").when(F.col("l_returnflag") == "N", "imports").otherwise("references")
    return li.select(
        F.concat(F.lit("n"), F.col("l_suppkey").cast("string")).alias("source"),
        F.concat(F.lit("n"), F.col("l_partkey").cast("string")).alias("target"),
        kind.alias("kind"),
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("source_file"),
        F.concat(F.lit("o"), F.col("l_partkey").cast("string")).alias("target_file"),
        F.col("l_linenumber").cast("int").alias("line"),
        F.concat(F.col("l_linestatus"), F.when(F.col("l_partkey") % 2 == 0, "/").otherwise("")).alias("repo"),
        F.lit("main").alias("branch"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").alias("ord"),
    )


EDGES = """edges AS (SELECT 'n' || l_suppkey AS source, 'n' || l_partkey AS target,
    CASE l_returnflag WHEN 'A' THEN 'calls' WHEN 'N' THEN 'imports' ELSE 'references' END AS kind, 'o' || l_orderkey AS source_file,
    'o' || l_partkey AS target_file, l_linenumber::INT AS line, l_linestatus || CASE WHEN l_partkey % 2 = 0 THEN '/' ELSE '' END AS repo, 'main' AS branch,
    {'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_suppkey, 'e': l_extendedprice, 'f': l_quantity} AS ord FROM lineitem)"""


def saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory saves from events, in order of (ts, event_id)."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").cast("string").alias("project"), F.lit("shared").alias("scope"), F.col("event_type").alias("hash"), us.alias("us"),
        F.concat(F.lit("**What**: "), F.col("event_type"), F.lit(" of "), F.col("user_id").cast("string"), F.lit("\n"), F.col("props")).alias("content"),
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("t"), (F.col("event_id") % 3).cast("string"))).alias("topic_key"),
        F.element_at(F.array(*[F.lit(x) for x in ("insight", "decision", "note")]), (F.col("event_id") % 3 + 1).cast("int")).alias("memory_type"),
        (F.col("event_id") % 13 == 0).alias("deleted"), "props", "value",
    )


SAVES = """saves AS (SELECT event_id, user_id::VARCHAR AS project, 'shared' AS scope, event_type AS hash, epoch_us(ts) AS us,
    '**What**: ' || event_type || ' of ' || user_id || chr(10) || props AS content, CASE WHEN event_id % 4 = 0 THEN 't' || (event_id % 3) END AS topic_key,
    (['insight','decision','note'])[(event_id % 3 + 1)::INT] AS memory_type, event_id % 13 = 0 AS deleted, props, value FROM events)"""


def index_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index records from orders: the latest of each (repo, branch) counts."""
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("/repos/c"), (F.col("o_custkey") % 50).cast("string"), F.when(F.col("o_orderkey") % 7 == 0, "/").otherwise("")).alias("repo_path"),
        F.col("o_orderpriority").alias("branch"), F.col("o_orderkey").alias("record"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("last_commit"),
        (F.col("o_orderkey") % 100).cast("long").alias("symbol_count"), F.col("o_orderdate").alias("indexed_at"),
    )


INDEX_STATE = """index_state AS (SELECT '/repos/c' || (o_custkey % 50) || CASE WHEN o_orderkey % 7 = 0 THEN '/' ELSE '' END AS repo_path, o_orderpriority AS branch,
    o_orderkey AS record, sha256(o_orderkey::VARCHAR) AS last_commit, (o_orderkey % 100)::BIGINT AS symbol_count, o_orderdate AS indexed_at FROM orders)"""


def stores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Local and shared rows: overlapping thirds of the documents; some differ, with either side newer."""
    f = files(spark, sf_dir).select(deterministic_id(F.col("repo"), F.col("branch"), F.col("file"), F.col("doc_id")).alias("id"), "doc_id", "repo", "branch", "content")
    stamp = lambda n: F.format_string("2025-01-%02dT00:00:00Z", (F.col("doc_id") % n + 1))
    local = f.where("doc_id % 3 <> 0").select("id", "repo", "branch", content_hash(F.col("content")).alias("content_hash"), stamp(28).alias("indexed_at"))
    altered = F.when(F.col("doc_id") % 5 == 0, F.concat(F.col("content"), F.lit("x"))).otherwise(F.col("content"))
    shared = f.where("doc_id % 3 <> 1").select("id", "repo", "branch", content_hash(altered).alias("content_hash"), stamp(20).alias("indexed_at"))
    return local, shared


STORES = (
    FILES
    + """, local AS (SELECT sha256(repo || ':' || branch || ':' || file || ':' || doc_id)[1:32] AS id, repo, branch, sha256(content)[1:16] AS content_hash,
    printf('2025-01-%02dT00:00:00Z', doc_id % 28 + 1) AS indexed_at FROM files WHERE doc_id % 3 <> 0),
shared AS (SELECT sha256(repo || ':' || branch || ':' || file || ':' || doc_id)[1:32] AS id, repo, branch,
    sha256(content || CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE '' END)[1:16] AS content_hash, printf('2025-01-%02dT00:00:00Z', doc_id % 20 + 1) AS indexed_at
    FROM files WHERE doc_id % 3 <> 1)"""
)


def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health checks of each user's store, from events."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("store"), "event_id", "ts", (F.col("value") >= 50).alias("healthy"))
