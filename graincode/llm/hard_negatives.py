"""Hard-negative mining over a pivot table.

Method: a component that fills every vector up to the largest norm (and is zero in an anchor) turns inner products into Euclidean
distances: d(q, x)^2 = |q|^2 + M^2 - 2 q.x. The pivot table stores, for every row, its distances to a few pivots; by the triangle
inequality |d(q, p) - d(x, p)| <= d(q, x) <= d(q, p) + d(x, p), which brackets a score from above and below. Rows lie in slabs sorted by
their nearest pivot and the distance to it, so brackets leave out whole slabs first and rows then; the exact integer product is made for
what survives. An anchor's bound comes from the exact scores of its own slab, without a join, and rises as a task finds better rows.

Anchors, a stated query set, are dealt in blocks and meet the slabs as blocks meet rows in a batch search; a round broadcasts blocks that are counted
to be at most ``BLOCK_BYTES``, and there are as many rounds as that takes. A task keeps the best rows of an anchor only, so
what is shuffled is those, whatever label or vector a third of all rows share. Scores are exact at any size: nothing is capped.

Defined cases: rows with a null label, vector or component, or a component that is not finite, take no part, nor do rows without an id; components
become integers by floor(scale * x), and scores must fit a long (otherwise the run ends with an error); a shorter vector counts as filled up
with zeros; rows that are equal in id, label and vector count once, other rows that share an id each take part, also as anchors, but not with
each other; equal scores go by the smaller id; an empty table gives no rows; other columns are not read; an anchor without positives or a positive without
negatives in its range gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import cut, shuffle_partitions

#: Pivots, and the rows (the first by a hash of the id) among which they are chosen; all rows are stored with their distances.
PIVOTS, SAMPLE = 16, 2000
#: Rows of a slab, anchors of a block, bytes of the blocks of a round, and anchors whose best rows a task holds before it hands them on.
SLAB, BLOCK, BLOCK_BYTES, HELD = 4096, 512, 64 << 20, 20_000
#: Share of the largest norm by which brackets are widened, for rounding of square roots.
SLACK = 1e-6

_TABLE = "n long, dim int, low array<double>, high array<double>, ids binary, labels binary, marks binary, vectors binary, dists binary"


def integer_vectors(vectors: DataFrame, label: Column, anchor: Column, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """id, label, anchor and v (array<bigint>) of the rows that take part."""
    v = F.col(vector_col)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    read = vectors.where(F.col(id_col).isNotNull() & label.isNotNull() & v.isNotNull() & whole)
    made = F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    return read.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), made.alias("v"))


def _dense(column, dim: int) -> np.ndarray:
    """Rows of arrays as a matrix of int64, filled up with zeros."""
    sizes = np.asarray(column.value_lengths())
    flat = np.asarray(column.flatten(), dtype=np.int64)
    if (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim), dtype=np.int64)
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


class Pivots:
    """Pivots in the space with one more component, and distances to them."""

    def __init__(self, sample: np.ndarray, dim: int, most: float, pivots: int):
        self.dim, self.most = dim, most
        z = self.augmented(sample)
        chosen, near = [0], self._to(z, z[:1])[:, 0]
        while len(chosen) < min(pivots, len(z)) and near.max() > 0:  # the farthest from those chosen so far
            chosen.append(int(near.argmax()))
            near = np.minimum(near, self._to(z, z[chosen[-1:]])[:, 0])
        self.at = z[chosen]

    def augmented(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.column_stack((x, np.sqrt(np.maximum(self.most - (x * x).sum(axis=1), 0))))

    @staticmethod
    def _to(z: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((z * z).sum(axis=1)[:, None] - 2 * z @ at.T + (at * at).sum(axis=1), 0))

    def rows(self, x: np.ndarray) -> np.ndarray:
        return self._to(self.augmented(x), self.at)

    def anchors(self, x: np.ndarray) -> np.ndarray:
        """Of anchors, whose added component is zero."""
        return self._to(np.column_stack((x.astype(np.float64), np.zeros(len(x)))), self.at)


def pivot_table(rows: DataFrame, pivots: int = PIVOTS) -> tuple[DataFrame, Pivots] | None:
    """Slabs with ids, labels, anchor marks, vectors and pivot distances of rows, stored in the shared folder; None if there are no rows."""
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"), F.max(norm).alias("most")).first()
    if not size["n"]:
        return None
    dim = max(size["dim"], 1)
    few = rows.orderBy(F.xxhash64("id"), "id", "label", "v").select("v").limit(SAMPLE).collect()  # a bounded sample
    sample = np.zeros((len(few), dim), dtype=np.int64)
    for i, r in enumerate(few):
        sample[i, : len(r["v"])] = r["v"]
    own = Pivots(sample, dim, size["most"], pivots)

    def measure(batches):
        for batch in batches:
            t = own.rows(_dense(batch.column("v"), dim))
            cell = t.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(t[np.arange(len(t)), cell])], [*batch.schema.names, "cell", "near"])

    def slabs(batches):
        held, n, last = [], 0, None
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            while n >= SLAB:
                whole = pa.Table.from_batches(held).combine_chunks()
                made, last = _slab(whole.slice(0, SLAB), own, last)
                yield made
                held, n = whole.slice(SLAB).to_batches(), n - SLAB
        if n:
            yield _slab(pa.Table.from_batches(held), own, last)[0]

    measured = rows.mapInArrow(measure, "id long, label long, anchor boolean, v array<bigint>, cell int, near double")
    order = ["cell", "near", "id", "label", "v"]
    dealt = measured.repartitionByRange(max(shuffle_partitions(rows.sparkSession), size["n"] // 200_000), "cell", "near", "id").sortWithinPartitions(*order)
    return cut(dealt.mapInArrow(slabs, _TABLE)), own


def _slab(rows: pa.Table, own: Pivots, last: tuple | None) -> tuple[pa.RecordBatch, tuple]:
    """One row of the table of sorted rows; those that equal the row before are left out. last: the row before the first."""
    rows = rows.combine_chunks()
    x = _dense(rows.column("v").combine_chunks(), own.dim)
    ids, labels = np.asarray(rows.column("id")), np.asarray(rows.column("label"))
    keys = np.column_stack((ids, labels, x))
    fresh = np.ones(len(ids), dtype=bool)
    fresh[1:] = (keys[1:] != keys[:-1]).any(axis=1)
    fresh[0] = last is None or tuple(keys[0]) != last
    ids, labels, x, marks = ids[fresh], labels[fresh], x[fresh], np.asarray(rows.column("anchor").to_numpy())[fresh]
    t = own.rows(x) if len(x) else np.zeros((0, len(own.at)))
    small = np.int32 if not len(x) or np.abs(x).max() < 1 << 31 else np.int64
    low, high = (t.min(axis=0), t.max(axis=0)) if len(x) else (np.zeros(len(own.at)), np.zeros(len(own.at)))
    made = [[len(ids)], [own.dim], [low.tolist()], [high.tolist()], *([a.tobytes()] for a in (ids.astype(np.int64), labels.astype(np.int64), marks.astype(np.uint8), x.astype(small), np.ascontiguousarray(t.T)))]
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), *[pa.binary()] * 5]
    names = [f.split()[0] for f in _TABLE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(made, kinds)], names), tuple(keys[-1])


class Slab:
    """A slab as arrays."""

    def __init__(self, row: dict):
        self.n, dim = row["n"], row["dim"]
        self.low, self.high = np.array(row["low"]), np.array(row["high"])
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.marks = np.frombuffer(row["marks"], np.uint8).astype(bool)
        self.x = np.frombuffer(row["vectors"], np.int32 if len(row["vectors"]) == 4 * self.n * dim else np.int64).reshape(self.n, dim)
        self.dists = np.frombuffer(row["dists"], np.float64).reshape(-1, self.n)
        self.most = int(np.abs(self.x).max()) if self.x.size else 0
        self.real = self.x.astype(np.float64)

    def scores(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact inner products with q: in floating point where every sum is a whole number below 2^53."""
        bound = self.most * int(np.abs(q).max(initial=0)) * max(len(q), 1)
        if bound < 1 << 53:
            real = q.astype(np.float64)
            return (self.real[rows] @ real if 4 * len(rows) < self.n else (self.real @ real)[rows]).astype(np.int64)
        if bound < 1 << 63:
            return self.x[rows].astype(np.int64) @ q
        return np.array([sum(a * b for a, b in zip(r.tolist(), q.tolist())) for r in self.x[rows]], dtype=np.int64)  # an error beyond a long

    def survivors(self, dq: np.ndarray, square: float, low: float, high: float, slack: float) -> np.ndarray | None:
        """Which rows may score from low to high, by their pivot distances; None if no row of the slab may. square: |q|^2 + M^2."""
        most = np.sqrt(max(square - 2 * low, 0)) + slack  # of a distance, for a score of low
        least = np.sqrt(max(square - 2 * high, 0)) - slack
        if (np.maximum(self.low - dq, dq - self.high) > most).any() or (self.high + dq < least).any():
            return None
        alive = (np.abs(self.dists - dq[:, None]) <= most).all(axis=0)
        if least > 0:
            alive &= (self.dists + dq[:, None] >= least).all(axis=0)
        return alive


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, equal ones by the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _anchors(table: DataFrame, own: Pivots, k: int) -> DataFrame:
    """Per anchor: id, key (of anchors that share an id), label, q, dq, square, and bound, below which no positive can be: from its own slab."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                s = Slab(row)
                at = np.flatnonzero(s.marks)
                if not len(at):
                    continue
                dq, bound, square = own.anchors(s.x[at]), [], []
                for a in at:
                    same = np.flatnonzero((s.labels == s.labels[a]) & (s.ids != s.ids[a]))
                    got = s.scores(s.x[a].astype(np.int64), same)
                    bound.append(int(np.partition(got, len(got) - k)[len(got) - k]) if len(got) >= k else None)
                    square.append(float((s.real[a] ** 2).sum() + own.most))
                q = s.x[at].astype(np.int64)
                data = [pa.array(s.ids[at]), pa.array(s.labels[at]), pa.array([v.tobytes() for v in q]), pa.array([d.tobytes() for d in dq]), pa.array(square), pa.array(bound, pa.int64())]
                yield pa.RecordBatch.from_arrays(data, ["id", "label", "q", "dq", "square", "bound"])

    found = table.mapInArrow(run, "id long, label long, q binary, dq binary, square double, bound long")
    return cut(found.withColumn("key", F.xxhash64("id", "label", "q")))


def _rounds(anchors: DataFrame, *more: str) -> list[DataFrame]:
    """Blocks of anchors, in rounds of blocks that are counted to be at most BLOCK_BYTES."""
    fields = ["id", "key", "label", "q", "dq", "square", *more]
    weight = F.octet_length("q") + F.octet_length("dq") + 128
    total = anchors.agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("bytes")).first()
    if not total["n"]:
        return []
    blocks, rounds = -(-total["n"] // BLOCK), -(-total["bytes"] // BLOCK_BYTES)
    dealt = anchors.withColumn("block", F.pmod(F.xxhash64("key", "id"), F.lit(blocks)))
    while rounds > 1:
        sizes = dealt.groupBy((F.col("block") % rounds).alias("r")).agg(F.sum(weight).alias("bytes"))
        if rounds >= blocks or sizes.agg(F.max("bytes")).first()[0] <= BLOCK_BYTES:
            break
        rounds *= 2
    packed = dealt.groupBy("block").agg(F.collect_list(F.struct(*fields)).alias("anchors"))  # BLOCK anchors or so
    return [packed if rounds == 1 else packed.where(F.col("block") % rounds == r) for r in range(min(rounds, blocks))]


class Anchor:
    def __init__(self, a: dict):
        self.id, self.key, self.label, self.square = a["id"], a["key"], a["label"], a["square"]
        self.q, self.dq = np.frombuffer(a["q"], np.int64), np.frombuffer(a["dq"], np.float64)
        self.bound, self.caps = a.get("bound"), a.get("caps")


def _met(table: DataFrame, rounds: list[DataFrame], search, schema: str) -> DataFrame:
    """The rows that search finds for every slab and anchor. search(slab, anchor, lists): lists by anchor and cap are kept in a task."""
    names = [f.split()[0] for f in schema.split(", ")]

    def batch_of(lists: dict) -> pa.RecordBatch:
        flat = [(*place, i, s) for place, best in lists.items() for s, i in best]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*flat)] if flat else [pa.array([], pa.int64())] * len(names), names)

    def run(batches):
        lists: dict[tuple, list[tuple[int, int]]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                slab = Slab(row)
                for a in map(Anchor, row["anchors"]):
                    search(slab, a, lists)
                    if len(lists) >= HELD:
                        yield batch_of(lists)
                        lists = {}
        yield batch_of(lists)

    pairs = [table.crossJoin(F.broadcast(r.select("anchors"))) for r in rounds]  # bounded by BLOCK_BYTES; blocks of the query set against slabs
    return reduce(DataFrame.unionByName, [p.mapInArrow(run, schema) for p in pairs])


def _merge(old: list[tuple[int, int]], scores: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    new = [(int(scores[j]), int(ids[j])) for j in _best(scores, ids, k)]
    return sorted(old + new, key=lambda x: (-x[0], x[1]))[:k]


def _firsts(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k first rows of every key, with their rank: Spark keeps k a key before it shuffles."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "row_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, positives: int = 5, negatives: int = 5, floor: int = 80, pivots: int = PIVOTS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows as of ``integer_vectors``.

    An anchor's positives are its first rows of the same label. For each of them, the first rows of other labels are returned whose score is
    at most the positive's and at least ``floor`` per cent of it.
    """
    spark, out = rows.sparkSession, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    stored = pivot_table(rows, pivots)
    if stored is None:
        return spark.createDataFrame([], out)
    table, own = stored
    anchors, slack = _anchors(table, own, positives), SLACK * (1 + np.sqrt(own.most))
    if anchors.limit(1).count() == 0:
        return spark.createDataFrame([], out)

    def positive(slab: Slab, a: Anchor, lists: dict) -> None:
        best = lists.get((a.id, a.key), [])
        bound = max([x for x in (a.bound, best[-1][0] if len(best) == positives else None) if x is not None], default=None)
        alive = slab.survivors(a.dq, a.square, -np.inf if bound is None else bound, np.inf, slack)
        if alive is None:
            return
        at = np.flatnonzero(alive & (slab.labels == a.label) & (slab.ids != a.id))
        scores = slab.scores(a.q, at)
        if bound is not None:
            at, scores = at[scores >= bound], scores[scores >= bound]
        if len(at):
            lists[a.id, a.key] = _merge(best, scores, slab.ids[at], positives)

    first = _met(table, _rounds(anchors, "bound"), positive, "anchor_id long, key long, row_id long, score long")
    pos = cut(_firsts(first, ["anchor_id", "key"], positives).where("score >= 0").drop("rank"))  # a negative score has no range
    caps = pos.groupBy(F.col("anchor_id").alias("id"), "key").agg(F.sort_array(F.collect_set("score")).alias("caps"))
    ranged = cut(anchors.join(caps, ["id", "key"]))
    if ranged.limit(1).count() == 0:
        return spark.createDataFrame([], out)

    def negative(slab: Slab, a: Anchor, lists: dict) -> None:
        lows = []
        for cap in a.caps:
            best = lists.get((a.id, a.key, cap), [])
            low = -(-floor * cap // 100)
            lows.append(max(low, best[-1][0]) if len(best) == negatives else low)
        alive = slab.survivors(a.dq, a.square, min(lows), max(a.caps), slack)
        if alive is None:
            return
        at = np.flatnonzero(alive & (slab.labels != a.label) & (slab.ids != a.id))
        scores = slab.scores(a.q, at)
        for cap, low in zip(a.caps, lows):
            fit = (scores >= low) & (scores <= cap)
            if fit.any():
                lists[a.id, a.key, cap] = _merge(lists.get((a.id, a.key, cap), []), scores[fit], slab.ids[at[fit]], negatives)

    second = _met(table, _rounds(ranged, "caps"), negative, "anchor_id long, key long, cap long, row_id long, score long")
    neg = _firsts(second, ["anchor_id", "key", "cap"], negatives)
    pairs = pos.select("anchor_id", "key", F.col("row_id").alias("positive_id"), F.col("score").alias("cap"))
    joined = pairs.join(neg, ["anchor_id", "key", "cap"])
    return joined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("row_id").alias("negative_id"), F.col("cap").alias("positive_score"), F.col("score").alias("negative_score"))
