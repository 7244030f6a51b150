"""Filter interaction audit: what each of five filters removes in every order of application.

Method: every document is a mask of failure bits. The masks of a part are counted into three histograms of 32 (all documents, those labelled
good, those labelled toxic), which are the rows of a matrix. What a filter keeps, removes, finds removed already or removes
alone is linear in them: four integer matrices of 32 by 600 (120 orders times 5 steps) give every outcome as a product.

The texts are read once and only their digests, bits and ids move. Copies are found by the SHA-256 of the text: a group of copies is summed
before it moves, by part, bits and labels, so that a group of any size reaches a task as few rows.

Defined cases: a null text is an empty one, a null source the part ''; a text without words fails the word count and has nothing to divide, so it
passes the ratios; an id that is null is neither smaller nor larger than another, so its row is no copy and makes none; rows of one id and
text are no copies of each other, and each counts; labels that contradict each other for an id count for both; an empty table
gives no rows; a text of any length is read whole; other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Filters by letter, as SQL that is true where a document fails: over n_words, n_distinct, n_upper, n_chars and text. The copies filter comes last.
FILTERS: tuple[tuple[str, str], ...] = (
    ("A", "n_words < 200"),
    ("B", "100 * n_distinct < 50 * n_words"),
    ("C", "100 * n_upper > 2 * n_chars"),
    ("D", "text RLIKE '[#$%&*|]'"),
)
COPIES = "E"
LETTERS = "".join(name for name, _ in FILTERS) + COPIES
_BIT = {name: 1 << i for i, name in enumerate(LETTERS)}
ORDERS = ["".join(p) for p in permutations(LETTERS)]
#: Columns of the matrices: an order and a step of it.
COLUMNS = [(order, step) for order in ORDERS for step in range(len(LETTERS))]


def outcome_matrices() -> dict[str, np.ndarray]:
    """0/1 matrices, masks by COLUMNS: whether a document of the mask is kept, removed, redundant or a unique failure there."""
    masks = np.arange(1 << len(LETTERS))[:, None]
    own = np.array([_BIT[order[step]] for order, step in COLUMNS])
    before = np.array([sum(_BIT[x] for x in order[:step]) for order, step in COLUMNS])
    fails, gone = masks & own != 0, masks & before != 0
    made = {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": (masks == own) & fails}
    return {name: m.astype(np.int64) for name, m in made.items()}


def failure_bits(docs: DataFrame, part: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, part, copy (SHA-256 of the text) and mask, the bits of FILTERS."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(part.cast("string"), F.lit("")).alias("part"), text.alias("text"))
    words = read.withColumn("words", F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)")))
    measured = words.select(
        "id", "part", "text", F.size("words").alias("n_words"), F.size(F.array_distinct("words")).alias("n_distinct"),
        F.regexp_count("text", F.lit("[A-Z]")).alias("n_upper"), F.char_length("text").alias("n_chars"),
    )
    mask = " + ".join(f"IF({sql}, {_BIT[name]}, 0)" for name, sql in FILTERS)
    return measured.select("id", "part", F.unhex(F.sha2("text", 256)).alias("copy"), F.expr(mask).alias("mask"))


def histograms(bits: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per part: arrays of 32 counts, of all documents, those labelled good and those labelled toxic."""
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    marks = marks.agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    marked = bits.join(marks, "id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    kind = ["copy", "mask", "part", "good", "toxic"]
    rows = marked.groupBy("id", *kind).agg(F.count(F.lit(1)).alias("n"))  # dealt by id already
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    summed = rows.groupBy(*kind).agg(F.sum("n").alias("n"), least.alias("least"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("loose"))
    first = F.min("least.id").over(Window.partitionBy("copy"))
    held = F.col("loose") + F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(0)
    split = summed.withColumn("first", first).select("mask", "part", "good", "toxic", "n", held.alias("held"))
    aggs = []
    for name, own in (("total", F.lit(True)), ("good", F.col("good")), ("toxic", F.col("toxic"))):
        cells = []
        for k in range(2 * _BIT[COPIES]):
            copy, mask = divmod(k, _BIT[COPIES])
            counted = F.col("n") - F.col("held") if copy else F.col("held")
            cells.append(F.sum(F.when(own & (F.col("mask") == mask), counted).otherwise(0)))
        aggs.append(F.array(*cells).alias(name))
    return split.groupBy("part").agg(*aggs)


def _products(batches):
    made = outcome_matrices()
    own = np.array([LETTERS.index(order[step]) for order, step in COLUMNS])
    by_filter = np.stack([made["removed"][:, own == f].sum(axis=1) for f in range(len(LETTERS))], axis=1)
    orders, steps = pa.array([o for o, _ in COLUMNS]), pa.array([s + 1 for _, s in COLUMNS], pa.int32())
    for batch in batches:
        total, good, toxic = (np.asarray(batch.column(c).flatten()).reshape(batch.num_rows, -1) for c in (1, 2, 3))
        out = {name: total @ m for name, m in made.items()}
        out |= {"good_lost": good @ made["removed"], "toxic_lost": toxic @ made["removed"], "shapley": (total @ by_filter)[:, own]}
        for i in range(batch.num_rows):
            part = pa.array([batch.column(0)[i].as_py()] * len(COLUMNS), pa.string())
            yield pa.RecordBatch.from_arrays([part, orders, steps, *[pa.array(m[i]) for m in out.values()]], ["part", "filter_order", "step", *out])


def audit(docs: DataFrame, labels: DataFrame, part: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per part, filter_order and step (from 1): kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley."""
    counts = histograms(failure_bits(docs, part, id_col, text_col), labels, id_col)
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return counts.mapInArrow(_products, "part string, filter_order string, step int, " + ", ".join(f"{n} long" for n in names))
