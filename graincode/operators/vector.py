"""Vector search: exact top-k with metadata filters, result shaping, symbol lookup, fallback and batch search."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graincode.functions.scalars import cosine, squared_l2
from graincode.functions.shared import broadcast_if, cut

#: What counts as a symbol for read_symbol.
SYMBOL_TYPES = ("function", "method", "class", "struct", "interface", "enum")


def where_metadata(points: DataFrame, **conditions) -> DataFrame:
    """A list means IN, a boolean or any other value equality; filters come before the distance."""
    parts = [F.col(k).isin(list(v)) if isinstance(v, (list, tuple)) else F.col(k) == F.lit(v) for k, v in conditions.items() if v is not None]
    return points.where(reduce(Column.__and__, parts)) if parts else points


def nearest(points: DataFrame, query: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """points with score, the k best: squared L2 (lower is better) or cosine (higher is better); ties by id. query: one row, q."""
    score = squared_l2(F.col("vector"), F.col("q")) if metric == "l2" else cosine(F.col("vector"), F.col("q"))
    scored = points.crossJoin(F.broadcast(query.limit(1))).withColumn("score", score).drop("q")  # one row is broadcast
    return scored.orderBy(F.asc("score") if metric == "l2" else F.desc("score"), "id").limit(k)


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", F.round("score", 4))


def top_k(points: DataFrame, query: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """As ``nearest``, ranked by the exact score and shown with four places."""
    return _rounded(nearest(points, query, k, metric))


def lineage_nearest(points: DataFrame, query: DataFrame, k: int, lineage: list[str], metric: str = "l2", widen: int = 4) -> DataFrame:
    """The k best points that are seen on a branch lineage (nearest branch first), with score: all of a file (repo, file) is seen from the
    first branch of the lineage that has a row of it, and not at all where that row is a deletion.

    A round takes the ``widen`` times k best points of any branch (every partition keeps that many at most), and looks up the
    branches of their files alone. If k of them are seen these are the answer, as every point that is left out ranks behind; otherwise the next
    round takes ``widen`` times more. No round shuffles points or resolves files that did not come near.
    """
    place = F.array_position(F.array(*[F.lit(b) for b in lineage]), F.col("branch"))
    own = points.where(F.col("branch").isin(lineage)).withColumn("_place", place)
    live, most = own.where(~F.coalesce("is_deletion", F.lit(False))), k * widen
    while True:
        hits = cut(nearest(live, query, most, metric))
        near = broadcast_if(hits.select("repo", "file").distinct())
        first = own.join(near, ["repo", "file"], "left_semi").groupBy("repo", "file").agg(F.min("_place").alias("_first"))
        seen = cut(hits.join(broadcast_if(cut(first)), ["repo", "file"]).where("_place = _first").select(*points.columns, "score"))
        if seen.count() >= k or hits.count() < most:
            return seen.orderBy(F.asc("score") if metric == "l2" else F.desc("score"), "id").limit(k)
        most *= widen


def search(points: DataFrame, query: DataFrame, k: int = 10, repo: str | None = None, branch: str | None = None, language: str | None = None, lineage: list[str] | None = None) -> DataFrame:
    """Top k by L2, then one row for each file and start line; texts of 500 characters. A lineage, where given, takes the place of the branch."""
    if lineage is None:
        hits = nearest(where_metadata(points, repo=repo, branch=branch, language=language), query, k)
    else:
        hits = lineage_nearest(where_metadata(points, repo=repo, language=language), query, k, lineage)
    best = Window.partitionBy("file", "start_line").orderBy("score", "id")
    own = _rounded(hits.withColumn("_r", F.row_number().over(best)).where("_r = 1"))
    return own.select("id", "score", "file", "symbol", "symbol_type", "start_line", "end_line", "language", F.substring("text", 1, 500).alias("text"))


def read_symbol(points: DataFrame, query: DataFrame, name: str) -> DataFrame:
    """Of the five nearest symbols: the exact name, else the first that contains it, else the nearest."""
    five = nearest(where_metadata(points, symbol_type=list(SYMBOL_TYPES)), query, 5)
    low = F.lower("symbol")
    tier = F.when(low == name.lower(), 0).when(low.contains(name.lower()), 1).otherwise(2)
    return _rounded(five.withColumn("tier", tier).orderBy("tier", "score", "id").limit(1))


def hybrid_fallback(local: DataFrame, shared: DataFrame) -> DataFrame:
    """Local hits; the shared ones only if there is no local hit at all. metric tells the meaning of score."""
    none = local.limit(1).agg((F.count(F.lit(1)) == 0).alias("_none"))
    rest = shared.crossJoin(F.broadcast(none)).where("_none").drop("_none")
    return local.withColumn("metric", F.lit("l2")).unionByName(rest.withColumn("metric", F.lit("cosine")))


def preview(hits: DataFrame, lines: int = 4) -> DataFrame:
    text = F.array_join(F.slice(F.split("text", "\n", -1), 1, lines), "\n")
    return hits.select("id", F.format_string("%.4f", F.col("score")).alias("score"), text.alias("preview"))


#: Bytes of query vectors (as doubles) that a block may have, and queries of it whose similarities are held at once.
BROADCAST_BYTES, PART = 256 << 20, 256


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Unit vectors of a slab or block; a zero vector stays one."""
    x = np.asarray(vectors.combine_chunks().flatten(), dtype=np.float64).reshape(len(vectors), -1)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _best(sim: np.ndarray, ids: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row of similarities the places of the k best, equal ones by id."""
    n = min(k, sim.shape[1])
    least = np.partition(sim, -n, axis=1)[:, -n]
    out = []
    for row, bound in zip(sim, least):
        at = np.flatnonzero(row >= bound)  # all that equal the last one too
        out.append(at[np.lexsort((ids[at], -row[at]))][:n])
    return out


def _meet(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.string()), ("score", pa.float64())])

    def run(points: pa.Table, queries: pa.Table) -> pa.Table:
        if not points.num_rows or not queries.num_rows:
            return schema.empty_table()
        ids, slab = np.array(points["id"].to_pylist(), dtype=object), _matrix(points["vector"]).T
        out = []
        for lo in range(0, queries.num_rows, PART):
            qs = queries.slice(lo, PART)
            sim = np.round(_matrix(qs["vector"]) @ slab, 12)  # equal vectors get equal scores, wherever they stand
            top = _best(sim, ids, k)
            own = np.repeat(qs["query_id"].to_numpy(), [len(x) for x in top])
            out.append(pa.Table.from_arrays([pa.array(own, pa.int64()), pa.array([j for x in top for j in ids[x]], pa.string()), pa.array(np.concatenate([row[x] for row, x in zip(sim, top)]))], schema=schema))
        return pa.concat_tables(out)

    return run


def batch_top_k(points: DataFrame, queries: DataFrame, k: int, block: int = 8192, slab: int = 20_000) -> DataFrame:
    """query_id, id, score: the k nearest points (cosine) of every row of queries (query_id, vector); ties by id.

    Queries are dealt in blocks and points in slabs, and each pair of them meets in a group of its own, so that a worker holds one slab, one block and
    the similarities of ``PART`` queries, whatever the number of either. Each keeps k candidates a query, which are merged by query. Exact search needs
    all pairs: points are shuffled once for each block, queries once for each slab. Rows between the two steps: queries times k times slabs.
    """
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dim")).first()
    if not size["n"]:
        return queries.select("query_id").where(F.lit(False)).withColumns({"id": F.lit(""), "score": F.lit(0.0)})
    block = max(1, min(block, BROADCAST_BYTES // (8 * max(1, size["dim"] or 1))))
    blocks, slabs = -(-size["n"] // block), max(1, points.count() // slab)
    every = lambda name, count: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)
    own = points.select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(slabs)).cast("int").alias("slab"), every("block", blocks))
    asked = queries.select("query_id", "vector", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), every("slab", slabs))
    found = own.groupBy("slab", "block").cogroup(asked.groupBy("slab", "block")).applyInArrow(_meet(k), "query_id long, id string, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).select("query_id", "id", F.round("score", 4).alias("score"))
