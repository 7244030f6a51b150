"""Symbol graph: edges, references and neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graincode.functions.scalars import file_stem, repo_name, trim_slashes
from graincode.operators.vector import nearest
from graincode.functions.shared import broadcast_if, cut

KEY = ["source", "target", "kind", "repo", "branch", "source_file"]


def last_by(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key: an aggregate, so that it combines before the shuffle."""
    rest = [c for c in rows.columns if c not in key and c != order]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_last")).select(*key, *[F.col(f"_last.{c}").alias(c) for c in rest])


def upsert(old: DataFrame | None, new: DataFrame, order: str = "ord") -> DataFrame:
    """Edges after adding new ones: repos without slashes at the end, the last row of a key wins."""
    new = last_by(new.withColumn("repo", trim_slashes(F.col("repo"))), KEY, order)
    return new if old is None else old.join(new.select(*KEY), KEY, "left_anti").unionByName(new)


def normalize(edges: DataFrame, order: str = "ord") -> DataFrame:
    """Repos without slashes at the end; the first of equal edges (with their line) stays."""
    key = ["source", "target", "kind", "source_file", "line", "repo", "branch"]
    return edges.withColumn("repo", trim_slashes(F.col("repo"))).groupBy(*key).agg(F.min(order).alias(order))


def remove_file(edges: DataFrame, file: str) -> DataFrame:
    return edges.where(F.col("source_file") != file)


def rename_file(edges: DataFrame, old: str, new: str) -> DataFrame:
    return edges.withColumns({c: F.when(F.col(c) == old, new).otherwise(F.col(c)) for c in ("source_file", "target_file")})


def callers(edges: DataFrame, symbol: str) -> DataFrame:
    return edges.where((F.col("kind") == "calls") & (F.col("target") == symbol))


def callees(edges: DataFrame, symbol: str) -> DataFrame:
    return edges.where((F.col("kind") == "calls") & (F.col("source") == symbol))


def dependents(edges: DataFrame, file: str) -> DataFrame:
    return edges.where((F.col("kind") == "imports") & (F.col("target_file") == file)).select("source_file").distinct()


def dependencies(edges: DataFrame, file: str) -> DataFrame:
    return edges.where((F.col("kind") == "imports") & (F.col("source_file") == file) & F.col("target_file").isNotNull()).select("target_file").distinct()


def find_references(edges: DataFrame, symbol: str) -> DataFrame:
    """Edges whose source or target holds the symbol, whatever the case; % and _ in it are wildcards."""
    return edges.where(_holds(symbol))


def _holds(symbol: str):
    return F.col("source").ilike(f"%{symbol}%") | F.col("target").ilike(f"%{symbol}%")


def get_references(edges: DataFrame, symbol: str, file_stem: str | None, repo: str = "", order: str = "ord", limit: int = 200) -> DataFrame:
    """References by symbol, then by its file's stem, one for each (file, line, kind), the first ``limit`` in order; total counts all.

    One scan: an edge that holds both is of the first pass. What is found is written once, and read for the rows and for the total.
    """
    own = edges.where(F.col("repo").contains(repo) & (_holds(symbol) | _holds(file_stem) if file_stem else _holds(symbol)))
    found = own.withColumn("pass", F.when(_holds(symbol), 1).otherwise(2))
    first = found.groupBy("source_file", "line", "kind").agg(F.min_by(F.struct("source", "target", "repo"), F.struct("pass", order)).alias("e"), F.min(F.struct("pass", order)).alias("o"))
    first = cut(first.select("source_file", "line", "kind", "e.*", F.col("o.pass").alias("pass"), F.col("o").alias("_o")))
    return first.orderBy("_o").limit(limit).drop("_o").withColumn("total", F.lit(first.count()))


def locate(points: DataFrame, query: DataFrame, symbol: str) -> str | None:
    """Stem of the file of the point of a symbol that is nearest to the query; none if there is no such point."""
    hit = nearest(points.where(F.col("symbol") == symbol), query, 1).select(file_stem(F.col("file")).alias("stem")).first()
    return None if hit is None else hit["stem"]


def references(edges: DataFrame, points: DataFrame, query: DataFrame, symbol: str, repo: str = "", branch: str | None = None, order: str = "ord") -> DataFrame:
    """``get_references`` of a symbol and of the stem of its file, which is looked up among the points first. Repos go by their last part."""
    own = edges if branch is None else edges.where(F.col("branch") == branch)
    name = repo.rstrip("/").rsplit("/", 1)[-1]
    return get_references(own.withColumn("repo", repo_name(F.col("repo"))), symbol, locate(points, query, symbol), name, order)


def touching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges one end of which is among nodes (node), each once: semi-joins, which Spark makes before edges are folded or shuffled."""
    near = broadcast_if(nodes.select("node"))
    out = edges.join(near.select(F.col("node").alias("source")), "source", "left_semi")
    return out.unionByName(edges.join(near.select(F.col("node").alias("target")), "target", "left_semi").join(near.select(F.col("node").alias("source")), "source", "left_anti")).select(*edges.columns)


def _rounds(touch, spark: SparkSession, symbol: str, depth: int) -> DataFrame:
    """Breadth-first rounds: touch gives the edges at a frontier, a frame of nodes that the round before met first."""
    frontier = spark.createDataFrame([(symbol,)], "node string")
    seen, out = frontier, None
    for step in range(1, depth + 1):
        touched = touch(frontier).withColumn("round", F.lit(step))
        if step < depth:
            touched = cut(touched)
            reached = touched.select(F.explode(F.array("source", "target")).alias("node")).distinct()
            frontier = cut(reached.join(seen, "node", "left_anti"))
            seen = cut(seen.unionByName(frontier))
        out = touched if out is None else out.unionByName(touched)
    return out


def subgraph(edges: DataFrame, symbol: str, depth: int = 2) -> DataFrame:
    """Edges met by breadth-first rounds in both directions, with the round (an edge may be met again in a later one).

    The first round is a filter, later ones meet the frontier, which is broadcast if it is counted to be small enough; what a round
    finds is written once, and read for the next frontier and for the result.
    """

    def touch(frontier: DataFrame) -> DataFrame:
        first = frontier.head(2)
        if len(first) == 1:
            return edges.where((F.col("source") == first[0]["node"]) | (F.col("target") == first[0]["node"]))
        return touching(edges, frontier)

    return _rounds(touch, edges.sparkSession, symbol, depth)


class Adjacency:
    """Edges stored by node, in buckets of both ends, so that a round reads the buckets of its frontier alone.

    Every edge is in the folder of its source's bucket and in that of its target's. A round asks for the buckets that the frontier falls into, at most
    ``buckets`` numbers, and for the nodes in them; an edge both ends of which are in the frontier is told by its source.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _bucket(self, node: str) -> Column:
        return F.pmod(F.xxhash64(node), F.lit(self.buckets)).cast("int")

    def write(self, edges: DataFrame) -> None:
        first = F.explode(F.array(F.lit(True), F.lit(False))).alias("_first")
        node = F.when(F.col("_first"), F.col("source")).otherwise(F.col("target"))  # made again after the shuffle, which moves an edge's own columns and its bucket
        rows = edges.select("*", first).withColumn("node", node).withColumn("bucket", self._bucket("node")).drop("node").hint("rebalance", "bucket")
        rows = rows.select(node.alias("node"), F.when(F.col("_first"), "source").otherwise("target").alias("end"), *edges.columns, "bucket")
        rows.sortWithinPartitions("bucket", "node").write.partitionBy("bucket").mode("overwrite").parquet(self.path)

    def touching(self, nodes: DataFrame) -> DataFrame:
        """Edges one end of which is among nodes, each once."""
        own = nodes.select("node").withColumn("bucket", self._bucket("node"))
        places = [r["bucket"] for r in own.select("bucket").distinct().collect()]  # at most self.buckets
        near = broadcast_if(own)
        rows = self.spark.read.parquet(self.path).where(F.col("bucket").isin(places))
        found = rows.join(near, ["bucket", "node"], "left_semi")
        twice = near.select(F.col("node").alias("source"))
        out = found.where("end = 'source'").unionByName(found.where("end = 'target'").join(twice, "source", "left_anti"))
        return out.drop("bucket", "node", "end")

    def subgraph(self, symbol: str, depth: int = 2) -> DataFrame:
        """As ``subgraph`` of the stored edges."""
        return _rounds(self.touching, self.spark, symbol, depth)
