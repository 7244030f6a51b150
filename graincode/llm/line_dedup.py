"""Line dedup: lines whose key is found in many documents, or was seen before, leave; the result is a bitmap, not a text.

Method: (key hash, document, position) of every line is taken from the texts once and written; the rows are range-partitioned, so that a
frequent line is spread over as many partitions as its rows need, and sorted by hash, document and position inside each; a window
streams the sorted rows and lets the first of each key and document through, partitions are reduced to one row a key (documents,
first occurrence), and those rows are merged by key. The positions of dropped lines come back as compressed bitmaps: one 64-bit mask
for each stretch of 64 lines that loses any, and nothing for the others. ``apply_bitmaps`` broadcasts them up to ``BROADCAST_MASKS``
masks and joins by shuffle beyond that.

All of it is DataFrame and SQL functions. Keys are compared by 128 bits of hash.

Defined cases: a null or empty text is one empty line; the key of a line is the line without ASCII white space at both ends and
with A-Z lower-cased; keys shorter than ``min_chars`` never leave; documents are counted by distinct id (a null id is one document);
rows with equal id and text share a bitmap and each keeps its row; a text of any length is read whole; an empty table gives no rows; other
columns are kept by ``apply_bitmaps`` and not read, but for those named like its results, which the results replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import broadcast_if, cut, fresh

_A, _B = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Frequent keys that may be broadcast.
BROADCAST_KEYS = 500_000
#: Masks of bitmaps that may be broadcast, at some 50 bytes each.
BROADCAST_MASKS = 400_000
_WHITE = " \t\n\x0b\f\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _tag(text: Column) -> Column:
    """Tells apart texts that share an id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _lower(x: Column) -> Column:
    """A-Z lower-cased; the two agree on ASCII, and ``translate`` looks every character up."""
    return F.when(F.octet_length(x) == F.char_length(x), F.lower(x)).otherwise(F.translate(x, _A, _B))


def line_rows(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """doc, tag, pos, h, g of every line that may leave; a key once a document row, with all its positions' hashes alike."""
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc", _tag(F.col("text")).alias("tag"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    rows = rows.select("doc", "tag", "pos", F.btrim("line", F.lit(_WHITE)).alias("line")).where(F.char_length("line") >= min_chars)
    rows = rows.select("doc", "tag", "pos", _lower(F.col("line")).alias("key"))
    return rows.select("doc", "tag", "pos", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g"))


def frequent_keys(rows: DataFrame, min_docs: int) -> DataFrame:
    """h, g, first (document, position) of keys found in at least min_docs documents. rows: written, as their ranges are sampled first."""
    dealt = rows.select("h", "g", "doc", "pos").repartitionByRange("h", "g", "doc").sortWithinPartitions("h", "g", "doc", "pos")
    # all rows of a key and document are in one partition: equal values of the partitioning columns are never parted, and the
    # window reads the rows as they are dealt and sorted, without another exchange
    turn = F.row_number().over(Window.partitionBy("h", "g", "doc").orderBy("pos"))
    each = dealt.withColumn("_turn", turn).where("_turn = 1").drop("_turn")
    whole = each.groupBy("h", "g").agg(F.count(F.lit(1)).alias("docs"), F.min(F.struct("doc", "pos")).alias("first"))
    return whole.where(F.col("docs") >= min_docs).select("h", "g", "first")


def drop_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each document row that loses lines: doc, tag, and masks, an array of (stretch, mask) sorted by stretch.

    Bit ``p % 64`` of the mask of stretch ``p / 64`` is set where line p leaves. With keep_first the first occurrence of a
    key (by id, then position) stays; without it all of them leave.
    """
    rows = cut(line_rows(docs, id_col, text_col, min_chars))
    keys = cut(frequent_keys(rows, min_docs))
    gone = rows.join(broadcast_if(keys, BROADCAST_KEYS), ["h", "g"])  # by shuffle, AQE splits a frequent key
    if keep_first:
        gone = gone.where(~(F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("pos") == F.col("first.pos"))))
    words = gone.groupBy("doc", "tag", F.shiftright("pos", 6).alias("stretch")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("mask"))
    return words.groupBy("doc", "tag").agg(F.array_sort(F.collect_list(F.struct("stretch", "mask"))).alias("masks"))


def _dense(masks: Column) -> Column:
    """A mask for every stretch up to the last one that loses a line."""
    gap = lambda m, i: F.array_repeat(F.lit(0).cast("long"), m["stretch"] - F.when(i == 0, -1).otherwise(F.try_element_at(masks, i)["stretch"]) - 1)
    return F.flatten(F.transform(masks, lambda m, i: F.concat(gap(m, i), F.array(m["mask"]))))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", kept_col: str = "kept_text", lines_col: str = "n_lines", dropped_col: str = "n_dropped") -> DataFrame:
    """docs with kept_col, lines_col and dropped_col, which replace columns of these names."""
    made = {c.lower() for c in (kept_col, lines_col, dropped_col)}
    own = docs.drop(*[c for c in docs.columns if c.lower() in made and c not in (id_col, text_col)])
    at = fresh(own, "line")
    names = own.columns
    bitmaps = cut(bitmaps)
    few = (bitmaps.agg(F.sum(F.size("masks"))).first()[0] or 0) <= BROADCAST_MASKS
    b = bitmaps.select(F.col("doc").alias(f"{at}_doc"), F.col("tag").alias(f"{at}_tag2"), _dense(F.col("masks")).alias(f"{at}_mask"))
    text = F.col(f"`{text_col}`").cast("string")
    own = own.withColumn(f"{at}_tag", _tag(text))
    both = own.join(F.broadcast(b) if few else b, own[id_col].eqNullSafe(F.col(f"{at}_doc")) & (F.col(f"{at}_tag") == F.col(f"{at}_tag2")), "left")
    mask = F.col(f"{at}_mask")
    stays = lambda line, i: F.getbit(F.coalesce(F.try_element_at(mask, F.shiftright(i, 6) + 1), F.lit(0).cast("long")), i % 64) == 0
    both = both.withColumn(f"{at}_all", _lines(text)).withColumn(f"{at}_kept", F.when(mask.isNotNull(), F.filter(f"{at}_all", stays)))
    kept = F.when(mask.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(f"{at}_kept", "\n"))
    total = F.size(f"{at}_all")
    dropped = F.when(mask.isNull(), 0).otherwise(total - F.size(f"{at}_kept"))
    return both.select(*[F.col(f"`{c}`") for c in names], kept.alias(kept_col), total.cast("long").alias(lines_col), dropped.cast("long").alias(dropped_col))


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text", **names: str) -> DataFrame:
    """docs with kept_text, n_lines and n_dropped (or as names has them, like ``apply_bitmaps``), which replace columns of these names."""
    return apply_bitmaps(docs, drop_bitmaps(docs, min_docs, min_chars, keep_first, id_col, text_col), id_col, text_col, **names)
