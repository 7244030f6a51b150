"""Benchmark decontamination by winnowing.

Method: of each window of ``window`` words the smallest hash of ``GRAM`` consecutive words in it (the winnowing fingerprint)
is kept; equal windows have equal fingerprints, so any span of ``window`` shared words is found. The distinct fingerprints of a document
are joined with those of the benchmark, and only the windows of joined ones are extended: spelled out and compared word by word.
Items shorter than a window are one window of their own length; they are joined by the hash of their first word and extended alike, in the same pass.

All of it is DataFrame and SQL functions. The fingerprints and windows of the benchmark are broadcast only if they are counted
to be at most ``BROADCAST_ROWS``; beyond that, fingerprints are joined by shuffle and matching documents are read again.

Defined cases: a null or empty text has no words and no hits; an item without words has no window; an item with a null id marks
words but is not listed; items that repeat count each by its id; documents that share id and text share the result and each keeps
its row; a text of any length is read whole; an empty table gives no rows, an empty benchmark no hits; other columns are not read, and
``drop_contaminated`` returns them as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import broadcast_if, cut, fresh

BROADCAST_ROWS = 1_000_000
GRAM = 5
_A, _B = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words: all of ASCII but digits and letters.
_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_NONE = "CAST(array() AS array<bigint>)"


def words_of(text: Column) -> Column:
    """The words as they stand; ``_span`` lower-cases A-Z where words are compared."""
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), _BREAK, -1), "")


def _tag(text: Column) -> Column:
    """Tells apart texts that share an id."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _span(at: Column, size) -> Column:
    return F.translate(F.array_join(F.slice("words", at + 1, size), " "), _A, _B)


def _each(count: Column, f) -> Column:
    """f of 0 to count - 1, as an array."""
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), f)).otherwise(F.expr(_NONE))


def fingerprints(df: DataFrame, window: int, short: bool = True) -> DataFrame:
    """df (with words) with fp, the fingerprint of the window that starts at each word, and (if short) first, the hash of each word.

    Words are hashed in full lower case, so that equal words have equal hashes and few others have.
    """
    gram = min(GRAM, window)
    df = df.withColumn("first", F.transform("words", lambda w: F.xxhash64(F.lower(w))))
    df = df.withColumn("_gram", _each(F.size("words") - gram + 1, lambda i: F.xxhash64(*[F.get("first", i + k) for k in range(gram)])))
    df = df if short else df.drop("first")
    low = F.col("_gram")
    if window > gram:
        low = _each(F.size("words") - window + 1, lambda i: F.least(*[F.get("_gram", i + k) for k in range(window - gram + 1)]))
    return df.withColumn("fp", low).drop("_gram")


def benchmark_windows(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """span, size, key (the fingerprint, or of short items the hash of the first word), items (sorted ids that hold the span) and items_id of every different window."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    items = fingerprints(items, window)
    long = items.select("item", "words", F.posexplode_outer("fp").alias("at", "key")).where("at IS NOT NULL").select("item", _span(F.col("at"), window).alias("span"), F.lit(window).alias("size"), "key")
    few = items.where(F.size("words") < window).select("item", _span(F.lit(0), F.size("words")).alias("span"), F.size("words").alias("size"), F.get("first", F.lit(0)).alias("key"))
    each = long.unionByName(few).groupBy("span", "size", "key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return cut(each.withColumn("items_id", F.sha2(F.array_join("items", ","), 256)))


def hits(docs: DataFrame, windows: DataFrame, window: int) -> DataFrame:
    """doc, tag, at, size, items_id of every occurrence of a benchmark window. docs: doc, tag, words."""
    total, few = windows.agg(F.count(F.lit(1)), F.count_if(F.col("size") < window)).first()
    names = ["doc", "tag", "words", "fp", *(["first"] if few else [])]
    own = fingerprints(docs, window, short=few > 0).select(names)
    keys = windows.select("key", "size").distinct()
    probes = F.array_distinct(F.concat("fp", "first") if few else F.col("fp"))
    # outer: the filter that Spark infers for a plain explode would be pushed through all steps that make the array
    if total <= BROADCAST_ROWS:
        met = own.select(*names, F.explode_outer(probes).alias("key")).join(F.broadcast(keys), "key")
    else:
        some = own.select("doc", "tag", F.explode_outer(probes).alias("key")).join(keys, "key").groupBy("doc", "tag").agg(F.collect_set(F.struct("key", "size")).alias("some"))
        some = some.withColumnsRenamed({"doc": "d", "tag": "t"})
        met = own.join(some, own["doc"].eqNullSafe(F.col("d")) & (own["tag"] == F.col("t"))).select(*names, F.explode("some").alias("one")).select(*names, "one.*")
    starts = F.when(F.size("words") >= F.col("size"), F.sequence(F.lit(0), F.size("words") - F.col("size"))).otherwise(F.expr("CAST(array() AS array<int>)"))
    same = lambda i: F.when(F.col("size") == window, F.get("fp", i)).otherwise(F.get("first", i) if few else F.lit(None)) == F.col("key")
    found = met.select("doc", "tag", "words", "size", F.explode(F.filter(starts, same)).alias("at"))
    found = found.select("doc", "tag", "at", "size", _span(F.col("at"), F.col("size")).alias("span"))
    spans = windows.select("span", "size", "items_id")
    return found.join(F.broadcast(spans) if total <= BROADCAST_ROWS else spans, ["span", "size"]).select("doc", "tag", "at", "size", "items_id")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """Per row: id, n_words, n_hit (words inside benchmark windows), n_items, items (comma-joined sorted ids), contaminated."""
    text = F.col(text_col).cast("string")
    slim = docs.select(F.col(id_col).alias("doc"), _tag(text).alias("tag"), text.alias("text"))
    windows = benchmark_windows(benchmark, window, item_id_col, item_text_col)
    found = hits(slim.select("doc", "tag", words_of(F.col("text")).alias("words")), windows, window)
    spans = F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["size"] - 1))
    per_doc = found.groupBy("doc", "tag").agg(F.collect_set(F.struct("at", "size")).alias("spans"), F.array_sort(F.collect_set("items_id")).alias("sets"))
    per_doc = cut(per_doc.select("doc", "tag", F.size(F.array_distinct(F.flatten(spans))).cast("long").alias("n_hit"), F.sha2(F.array_join("sets", ","), 256).alias("combo"), "sets"))
    # documents share few combinations of item sets: lists are made once for each combination, not for each document
    combos = per_doc.groupBy("combo").agg(F.first("sets").alias("sets")).select("combo", F.explode("sets").alias("items_id"))
    lists = combos.join(windows.select("items_id", "items").dropDuplicates(["items_id"]), "items_id").select("combo", F.explode("items").alias("item")).distinct()
    lists = lists.groupBy("combo").agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    result = per_doc.join(lists, "combo", "left").select(F.col("doc").alias("_doc"), F.col("tag").alias("_tag"), "n_hit", "n_items", "items")
    counts = slim.select("doc", "tag", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    joined = counts.join(result, counts["doc"].eqNullSafe(result["_doc"]) & (counts["tag"] == result["_tag"]), "left")
    return joined.select(
        F.col("doc").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items", F.lit("")).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """The rows of docs without any occurrence of a benchmark window; all their columns stay as they are."""
    text, tag = F.col(text_col), fresh(docs, "tag")
    slim = docs.select(F.col(id_col).alias("doc"), _tag(text).alias("tag"), words_of(text).alias("words"))
    found = hits(slim, benchmark_windows(benchmark, window, item_id_col, item_text_col), window)
    found = cut(found.select(F.col("doc").alias(f"{tag}_doc"), F.col("tag").alias(f"{tag}_hit")).distinct())
    own = docs.withColumn(tag, _tag(text))
    return own.join(broadcast_if(found, BROADCAST_ROWS), own[id_col].eqNullSafe(F.col(f"{tag}_doc")) & (own[tag] == F.col(f"{tag}_hit")), "left_anti").drop(tag)
