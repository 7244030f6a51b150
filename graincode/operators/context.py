"""Packing texts into a token budget."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graincode.functions.scalars import context_cost, squared_l2

#: Fixed value: default budget.
BUDGET = 4096
#: Endings of file-like words, and what is trimmed from words.
HINT_SUFFIXES = (".ts", ".js", ".java", ".html", ".css", ".service", ".component", ".interface")
HINT_TRIM = ",.;:()[]{}\"'`"


def pack_prefix(rows: DataFrame, keys: list[str], order: list, cost: str, budget: int) -> DataFrame:
    """Rows of each key up to the first that does not fit: costs are not negative, so a running sum decides."""
    run = F.sum(cost).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used", run).where(F.col("used") <= budget)


def _greedy(rows: Column, budget: int) -> Column:
    """Of rows (o, c) of positive cost, those kept when the ones that do not fit are skipped: ``budget`` of them at most."""
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.filter(rows, lambda x: F.lit(False)).alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        more = F.struct((acc["used"] + x["c"]).alias("used"), F.concat(acc["kept"], F.array(x)).alias("kept"))
        return F.when(acc["used"] + x["c"] <= budget, more).otherwise(acc)

    return F.aggregate(rows, zero, step)["kept"]


def pack_greedy(rows: DataFrame, keys: list[str], order: str, cost: str, budget: int) -> DataFrame:
    """keys, order and cost of the rows kept of each key, in order, when rows that do not fit are skipped.

    Rows that cost nothing always fit and rows dearer than the budget never do; only orders and costs of the others are gathered, by key.
    """
    slim = rows.select(*keys, F.col(order).alias("o"), F.col(cost).cast("long").alias("c")).where(F.col("c").between(0, budget))
    lists = slim.where("c > 0").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("o", "c"))).alias("_l"))
    kept = lists.select(*keys, F.inline(_greedy(F.col("_l"), budget)))
    return kept.unionByName(slim.where("c = 0")).select(*keys, F.col("o").alias(order), F.col("c").alias(cost))


def _hints(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, at and hint, in the order of (at, slash): words with a file-like ending, and again words with a slash of more than three bytes."""
    words = rows.select(*keys, F.posexplode(F.split(text, r"\s+")).alias("at", "w")).select(*keys, "at", F.btrim("w", F.lit(HINT_TRIM)).alias("hint"))
    ending = F.lit(False)
    for s in HINT_SUFFIXES:
        ending = ending | F.col("hint").endswith(s)
    own = words.where(ending).withColumn("slash", F.lit(False))
    return own.unionByName(words.where(F.col("hint").contains("/") & (F.octet_length("hint") > 3)).withColumn("slash", F.lit(True)))


def file_hints(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and hint: words with a file-like ending, and again words with a slash of more than three bytes."""
    return _hints(rows, keys, text).select(*keys, "hint")


def _relevant(memories: DataFrame, cutoff: float) -> DataFrame:
    return memories.where((F.col("score") < cutoff) & (F.col("text") != ""))


def hint_hits(memories: DataFrame, points: DataFrame, embed: Callable[[DataFrame], DataFrame], k: int = 3, cutoff: float = 1.5) -> DataFrame:
    """pos, file, start_line and text of the k points nearest to each file hint of the memories that are near enough, in order.

    embed gives (hint, q) for a frame of distinct hints. They come from a top-k result and are broadcast; points are reduced to the
    k best of a hint in each partition before the shuffle. As in ``search``, one row stays for each file and start line of a hint.
    """
    hints = _hints(_relevant(memories, cutoff).select(F.col("pos").alias("memory"), "text"), ["memory"], "text")
    score = squared_l2(F.col("vector"), F.col("q"))
    near = points.crossJoin(F.broadcast(embed(hints.select("hint").distinct()))).select("hint", "id", score.alias("score"), "file", "start_line", F.substring("text", 1, 500).alias("text"))
    near = near.withColumn("_r", F.row_number().over(Window.partitionBy("hint").orderBy("score", "id"))).where(F.col("_r") <= k)
    near = near.withColumn("_r", F.row_number().over(Window.partitionBy("hint", "file", "start_line").orderBy("score", "id"))).where("_r = 1")
    order = Window.partitionBy(F.lit(1)).orderBy("memory", "at", "slash", "score", "id")  # a few rows for each hint
    return hints.join(near, "hint").select(F.row_number().over(order).alias("pos"), "file", "start_line", "text")


def _chunk(hits: DataFrame) -> DataFrame:
    """pos, file and note."""
    return hits.select("pos", "file", F.concat(F.lit("// "), "file", F.lit(":"), F.col("start_line").cast("string"), F.lit("\n"), "text", F.lit("\n\n")).alias("note"))


def build_context(memories: DataFrame, hits: DataFrame, budget: int = BUDGET, cutoff: float = 1.5, hinted: DataFrame | None = None) -> DataFrame:
    """part, pos and note of the context: memories (score, text) near enough, then hinted chunks, as far as they fit, then hits.

    Hits of files that the context names already are skipped; the others follow until one does not fit. memories and hits are top-k
    results, hinted is what ``hint_hits`` found; ``pos`` is their rank.
    """
    m = _relevant(memories, cutoff).select(F.lit("memory").alias("part"), "pos", F.concat(F.lit("// [memory] "), "text", F.lit("\n\n")).alias("note"))
    if hinted is not None:
        m = m.unionByName(_chunk(hinted).select(F.lit("hint").alias("part"), "pos", "note"))
    m = m.withColumns({"cost": context_cost(F.col("note")), "g": F.lit(1), "at": F.struct((F.col("part") == "hint").alias("hint"), F.col("pos"))})
    kept = m.join(pack_greedy(m, ["g"], "at", "cost", budget).select("at"), "at", "left_semi")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "note"))), lambda x: x["note"]), "")
    used = kept.agg(F.coalesce(F.sum("cost"), F.lit(0)).alias("before"), text.alias("there"))  # a text of the budget's size
    h = _chunk(hits).crossJoin(F.broadcast(used)).where(~F.coalesce(F.contains("there", F.concat(F.lit("// "), "file", F.lit(":"))), F.lit(False)))
    h = h.withColumn("cost", context_cost(F.col("note")))
    run = F.sum("cost").over(Window.partitionBy("before").orderBy("pos"))
    h = h.withColumn("used", run + F.col("before")).where(F.col("used") <= budget).select(F.lit("code").alias("part"), "pos", "note", "cost")
    return kept.select("part", "pos", "note", "cost").unionByName(h)
