"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Method: a text is a sparse vector of hashed lower-cased words (log counts, unit length), of its structure statistics (each as
the bins, of ``BINS``, up to its own) and of metadata (the bin of the stated length, or its absence). Pairwise interactions have rank ``RANK`` and
are scored in linear time as half of (square of sums less sum of squares). Learned by AdaGrad on the logistic loss from at most
``TRAIN_ROWS`` labelled rows; the model is a fixed-size table, so broadcasting it is bounded.

Defined cases: a null text is an empty one and gets a score; a null length has its own bin; without labels of both classes the score
is the share of label 1 (0.5 without any); a text of any length is read whole, in one piece of its own if it is long; every input row
gives one output row, repeated rows and null ids too; an empty table gives no rows; other columns, whatever their names, are not read,
but for the length, and ``score`` returns them as they are, but for one named like its result, which the result replaces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import fold, training_rows
from .runtime import release_memory, releasing, text_batches
from .textnum import Words, blobs_of, pieces

#: Labelled rows to learn from, at most.
TRAIN_ROWS = 6000
WORD_BITS, RANK, BINS, EPOCHS, BATCH = 16, 8, 16, 14, 128
_STATS = 13
SIZE = (1 << WORD_BITS) + (_STATS + 1) * (BINS + 1)
_TABLES = np.zeros((6, 256), dtype=np.uint8)
for _row, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"!?", b"|<>{}[]=", b"#*$%&@^~_+")):
    _TABLES[_row, list(_bytes)] = 1


def _statistics(words: Words) -> np.ndarray:
    """A row of statistics in [0, 1] for each text."""
    buf = np.frombuffer(words.raw, dtype=np.uint8)
    n = words.counts().astype(float)
    one = np.maximum(n, 1)
    ends = np.cumsum([0] + words.sizes)
    first = ends[:-1]
    per = lambda flags: np.add.reduceat(flags.astype(np.int64), first) if len(first) else np.zeros(0)
    upper, lower, digit, loud, table, sign = (per(t[buf]) for t in _TABLES)
    wide = per(buf >= 0x80)
    letters = np.maximum(upper + lower + wide, 1)
    same = np.zeros(len(words.hash), dtype=bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    again = np.bincount(words.doc[same], minlength=words.texts)
    key = np.lexsort((words.hash, words.doc))
    new = np.ones(len(key), dtype=bool)
    new[1:] = (words.hash[key][1:] != words.hash[key][:-1]) | (words.doc[key][1:] != words.doc[key][:-1])
    kinds = np.bincount(words.doc[key][new], minlength=words.texts)
    size = np.array(words.sizes, dtype=float)
    length = np.bincount(words.doc, weights=words.end - words.start, minlength=words.texts) / one
    lines = per(buf == 10)
    return np.stack(
        [
            np.log2(n + 1) / 20, length / 20, upper / letters, letters / np.maximum(size, 1), digit / np.maximum(size, 1), loud / one, table / one,
            sign / one, kinds / one, again / one, lines / one, wide / np.maximum(size, 1), np.log2(size + 1) / 30,
        ],
        axis=1,
    ).clip(0, 1)


def features(blobs: list[bytes], n_chars: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, index and value of all entries, sorted by text."""
    words = Words([b.lower() for b in blobs])
    key, count = np.unique((words.doc.astype(np.int64) << WORD_BITS) | (words.hash >> np.uint64(64 - WORD_BITS)).astype(np.int64), return_counts=True)
    doc, value = key >> WORD_BITS, np.log1p(count)
    value = value / np.sqrt(np.bincount(doc, weights=value**2, minlength=len(blobs)))[doc]
    stats = _statistics(Words(blobs))
    stated = np.array([-1.0 if c is None else min(1.0, np.log2(max(c, 0) + 1) / 30) for c in n_chars])
    bins = np.concatenate((np.round(stats**0.5 * (BINS - 1)), np.where(stated < 0, BINS, np.round(stated * (BINS - 1)))[:, None]), axis=1).astype(np.int64)
    width, place = _STATS + 1, np.arange(BINS + 1)
    reached = (place <= bins[:, :, None]) & (place < BINS) | (place == bins[:, :, None])  # all bins up to the own one
    reached[:, -1, :-1] &= bins[:, -1, None] < BINS  # an absent length is in its own bin only
    text, stat, cell = np.nonzero(reached)
    doc = np.concatenate((doc, text))
    index = np.concatenate((key & ((1 << WORD_BITS) - 1), (1 << WORD_BITS) + stat * (BINS + 1) + cell))
    value = np.concatenate((value, np.full(len(text), 0.5)))
    order = np.argsort(doc, kind="stable")
    return doc[order], index[order], value[order].astype(np.float32)


class Machine:
    """bias, weights (SIZE) and factors (SIZE, RANK)."""

    def __init__(self, bias: float, weights: np.ndarray | None = None, factors: np.ndarray | None = None):
        self.bias, self.weights, self.factors = bias, weights, factors

    def margins(self, doc: np.ndarray, index: np.ndarray, value: np.ndarray, texts: int) -> np.ndarray:
        if self.weights is None or not texts:
            return np.full(texts, self.bias)
        first = np.searchsorted(doc, np.arange(texts))  # every text has entries: its statistics
        vx = self.factors[index] * value[:, None]
        sums, squares = np.add.reduceat(vx, first), np.add.reduceat(vx**2, first)
        return self.bias + np.add.reduceat(self.weights[index] * value, first) + 0.5 * (sums**2 - squares).sum(axis=1)

    def scores(self, *args) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(*args), -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 1) -> Machine:
    """AdaGrad over mini-batches of rows of (index, value)."""
    n = len(y)
    if n == 0:
        return Machine(0.0)
    rate = (y.sum() + 0.5) / (n + 1)
    bias = float(np.log(rate / (1 - rate)))
    if y.min() == y.max():
        return Machine(bias)
    rng = np.random.default_rng(seed)
    w, v = np.zeros(SIZE, dtype=np.float32), rng.normal(0, 0.02, (SIZE, RANK)).astype(np.float32)
    gw, gv = np.full(SIZE, 1e-2, dtype=np.float32), np.full((SIZE, RANK), 1e-2, dtype=np.float32)
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for lo in range(0, n, BATCH):
            pick = order[lo : lo + BATCH]
            size = np.array([len(rows[i][0]) for i in pick])
            index, value = np.concatenate([rows[i][0] for i in pick]), np.concatenate([rows[i][1] for i in pick])
            doc, first = np.repeat(np.arange(len(pick)), size), np.cumsum(size) - size
            vx = v[index] * value[:, None]
            sums = np.add.reduceat(vx, first)
            margin = bias + np.add.reduceat(w[index] * value, first) + 0.5 * (sums**2 - np.add.reduceat(vx**2, first)).sum(axis=1)
            slope = ((1 / (1 + np.exp(-np.clip(margin, -30, 30)))) - y[pick])[doc] * value
            used, at = np.unique(index, return_inverse=True)
            step = np.bincount(at, weights=slope, minlength=len(used)) / len(pick) + 1e-5 * w[used]
            inner = (sums[doc] - vx) * slope[:, None]
            grad = np.stack([np.bincount(at, weights=inner[:, k], minlength=len(used)) for k in range(RANK)], axis=1) / len(pick) + 1e-5 * v[used]
            gw[used] += step**2
            gv[used] += grad**2
            w[used] -= 0.2 * step / np.sqrt(gw[used])
            v[used] -= 0.03 * grad / np.sqrt(gv[used])
    return Machine(bias, w, v)


def _extract(batches):
    for batch in batches:
        blobs, lengths, y = blobs_of(batch.column(1)), batch.column(2).to_pylist(), batch.column(3)
        for a, b in pieces(blobs):
            doc, index, value = features(blobs[a:b], lengths[a:b])
            edge = pa.array(np.searchsorted(doc, np.arange(b - a + 1)), pa.int32())
            parts = [pa.ListArray.from_arrays(edge, pa.array(x)) for x in (index.astype(np.int32), value)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), y.slice(a, b - a), *parts], ["id", "y", "index", "value"])


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held: int = 0, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Machine:
    text_batches(docs.sparkSession)
    slim = _slim(docs, id_col, text_col)
    sample = training_rows(slim, labels.select(F.col(id_col).cast("string").alias("id"), label), label, folds, held, rows, "id").select("id", "text", "n_chars", "y")
    got = sample.mapInArrow(releasing(_extract), "id string, y int, index array<int>, value array<float>").toArrow().sort_by("id")
    index, value = (got[c].combine_chunks() for c in ("index", "value"))
    edge = np.asarray(index.offsets)
    flat = [(np.asarray(index.values)[a:b].astype(np.int64), np.asarray(value.values)[a:b]) for a, b in zip(edge[:-1], edge[1:])]
    machine = fit(flat, np.asarray(got["y"]).astype(float))
    del got, index, value, flat
    release_memory()
    return machine


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    length = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), length.alias("n_chars"))


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", as_col: str = "score") -> DataFrame:
    """docs with as_col, in [0, 1]."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    kept = [f for f in docs.schema.fields if f.name.lower() != as_col.lower()]
    n = len(kept)
    stated = F.col(f"`{length_col}`").cast("long") if length_col in docs.columns else F.lit(None).cast("long")

    def run(batches):
        own = shared.value
        for batch in batches:
            blobs, lengths = blobs_of(batch.column(n)), batch.column(n + 1).to_pylist()
            out = [own.scores(*features(blobs[a:b], lengths[a:b]), b - a) for a, b in pieces(blobs)]
            scores = pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], scores], [*[f.name for f in kept], as_col])

    read = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{text_col}`").cast("string").alias("_text"), stated.alias("_stated"))  # what is read goes last, by place
    return read.mapInArrow(releasing(run), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", `{as_col}` double")


def classify(docs: DataFrame, labels: DataFrame, cut: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, score, predicted (1 if score >= cut)."""
    machine = learn(docs, labels, id_col=id_col, text_col=text_col)
    slim = docs.select(id_col, text_col, *(["n_chars"] if "n_chars" in docs.columns else []))
    out = score(slim, machine, id_col, text_col)
    return out.select(id_col, (fold(F.col(id_col), 5) == 0).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
