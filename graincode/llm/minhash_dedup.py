"""MinHash near-dedup with HyperMinHash registers.

Method: each distinct word shingle falls into one of ``BUCKETS`` buckets; a bucket keeps the smallest hash as a 16-bit register of its
leading-zero count (6 bits) and the ``MANTISSA`` bits that follow the first one. Empty buckets of small sets borrow the register of another
bucket, in a fixed order. As many registers make a band as keep the chance to miss a pair at the threshold under ``MISS``; sets that share
a band are candidates. Candidates whose collision-corrected Jaccard estimate is hopeless are left out, the others are verified on their
full shingle sets.

Groups: equal sets are one class. A band's members are first compared with one hub only, the one that shares bands with most others (as
many pairs as rows, whatever the size of the group), which joins the copies of one text. Jaccard distance is a metric: a member that is
more than twice the linking distance from the hub can't be linked to one that is linked to the hub. What this leaves open is settled by
bounds that hold for every pair. Only shingles that are also found in another component count towards a new link, so a member with too few
of them has none. Those shingles are counted in ``GROUPS`` groups by hash; two sets have no more in common than the sum, over
groups, of the smaller count, and pairs are made only where that is enough for a link. No pair is left out for the size of a group.

A pair at the threshold is missed if it shares no band: at 0.85, with 64 bands of 8 registers, once in 7e8 pairs; at 0.8, with 73 bands of
7, once in 3e7 (registers taken as independent; a test measures it). A missed pair can still be linked by others. What bands of many texts that are near each
other but not linked cost is the evaluation of the bounds for the pairs of a band in a join; no row is made of a pair that fails them.

Defined cases: a text without words, or a null one, has no set and is its own component; a text of fewer words than a shingle has
its whole sequence as the only shingle; a row with a null id is never linked and has a null component; rows that share an id are
judged by their own texts; every input row gives one output row of ``near_duplicates``; an empty table gives no rows; texts of any length are
read whole, a set is one row of 8 bytes a shingle; other columns are not read, and ``keep_one`` returns them as they are,
whatever their names.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import arrow_rows, broadcast_if, cut, fresh, releasing
from .textnum import Words, blobs_of, mix, ngrams, signed, slices

BUCKETS, MANTISSA = 512, 10
WORDS = BUCKETS // 4  # registers go as 64-bit words
_BUCKET_BITS = BUCKETS.bit_length() - 1
#: The chance to miss a pair at the threshold, at most.
MISS = 1e-7
#: Groups in which a set's shingles are counted for the bound of a pair, and the fewer ones of a bound that is tried first.
GROUPS, COARSE = 64, 8
#: Rows that go to Python at once.
BATCH_ROWS = 500
#: Ids that may be broadcast to pick texts.
BROADCAST_IDS = 1_000_000
#: Estimates this far (in similarity) below the threshold are not verified: over ten standard deviations at 512 registers below what counts as near.
MARGIN = 0.35
_ORDER = np.argsort(np.random.default_rng(7).random((BUCKETS, BUCKETS)), axis=1)


def miss_rate(band: int, similarity: float) -> float:
    """The chance that two sets of this similarity share no band of ``band`` registers."""
    return (1 - similarity**band) ** (BUCKETS // band)


def band_size(percent: int) -> int:
    """The most registers of a band that keep the miss rate at the threshold under MISS."""
    return max([b for b in range(2, 17) if miss_rate(b, percent / 100) <= MISS], default=2)


def _shingles(blobs: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted by text and hash, the text of each, and the first of each text."""
    words = Words([b.lower() for b in blobs])
    count = words.counts()
    at = np.flatnonzero(words.doc[: max(0, len(words.hash) - n + 1)] == words.doc[n - 1 :])
    doc, h = words.doc[at], ngrams(words.hash, n)[at]
    few = np.flatnonzero((count > 0) & (count < n))
    if len(few):
        first = np.searchsorted(words.doc, few)
        whole = np.array([ngrams(words.hash[f : f + count[d]], int(count[d]), 40 + int(count[d]))[0] for d, f in zip(few, first)], dtype=np.uint64)
        doc, h = np.concatenate((doc, few.astype(np.int32))), np.concatenate((h, whole))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    doc, h = doc[new], h[new]
    return h, doc, np.searchsorted(doc, np.arange(len(blobs) + 1))


def _registers(h: np.ndarray, doc: np.ndarray, texts: int) -> np.ndarray:
    """uint16 registers, a row for each text."""
    value = mix(h, 3)
    low = np.full((texts, BUCKETS), np.uint64(2**63), dtype=np.uint64)
    np.minimum.at(low.reshape(-1), doc.astype(np.int64) * BUCKETS + (value & np.uint64(BUCKETS - 1)).astype(np.int64), value >> np.uint64(_BUCKET_BITS))
    empty = low == np.uint64(2**63)
    row, bucket = np.nonzero(empty & ~empty.all(axis=1)[:, None])
    for step in range(BUCKETS):
        if not len(row):
            break
        source = _ORDER[bucket, step]
        found = ~empty[row, source]
        low[row[found], bucket[found]] = low[row[found], source[found]]
        row, bucket = row[~found], bucket[~found]
    bits = 64 - _BUCKET_BITS
    length = np.frexp(low.astype(np.float64))[1]  # bits from the first one on
    zeros = bits - np.minimum(length, bits)
    shift = length - 1 - MANTISSA
    rest = np.where(shift >= 0, low >> np.maximum(shift, 0).astype(np.uint64), low << np.maximum(-shift, 0).astype(np.uint64))
    return (zeros.astype(np.uint16) << MANTISSA) | (rest & np.uint64((1 << MANTISSA) - 1)).astype(np.uint16)


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).view(np.int64).ravel()))


def _signatures(shingle: int, band: int):
    count = BUCKETS // band

    def run(batches):
        for part in (x for batch in batches for x in slices(batch, 1)):
            blobs = blobs_of(part.column(1))
            h, doc, edge = _shingles(blobs, shingle)
            total = [np.concatenate(([0], np.cumsum(mix(h, salt)))).astype(np.uint64) for salt in (71, 72)]
            keys = [signed(t[edge[1:]] - t[edge[:-1]]) for t in total]  # sums of hashes: equal for equal sets
            registers = _registers(h, doc, len(blobs))
            bands = np.full((len(blobs), count), np.uint64(17))
            for k in range(band):
                bands = mix(bands ^ registers[:, k : count * band : band].astype(np.uint64), 80 + k)
            bands = mix(bands ^ np.arange(count, dtype=np.uint64), 99)
            tag = pa.array([zlib.crc32(x) for x in blobs], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), tag, pa.array(np.diff(edge).astype(np.int64)), pa.array(keys[0]), pa.array(keys[1]), _lists(bands)], ["doc", "tag", "n", "k1", "k2", "bands"])

    return run


def _sketches(shingle: int):
    """Registers and shingles of texts (rep, text)."""

    def run(batches):
        for part in (x for batch in batches for x in slices(batch, 1)):
            blobs = blobs_of(part.column(1))
            h, doc, edge = _shingles(blobs, shingle)
            shingles = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(signed(h)))
            registers = _lists(_registers(h, doc, len(blobs)).view(np.uint64))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(edge).astype(np.int64)), registers, shingles], ["rep", "n", "registers", "shingles"])

    return run


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates of rows of registers of sets of na and nb shingles."""
    same = (a == b).mean(axis=1)
    big, small = np.maximum(na, nb), np.minimum(na, nb)
    chance = 0.16991948 * 4 * (big / small) / (1 + big / small) ** 2 / 2**MANTISSA  # registers of different shingles that agree
    return np.clip((same - chance) / (1 - chance), 0, 1)


def _promising(least: float, ratio: float):
    def run(batches):
        for batch in batches:
            a, b = (np.asarray(batch.column(i).flatten()).view(np.uint16).reshape(-1, BUCKETS) for i in (4, 5))
            na, nb = (np.asarray(batch.column(i)).astype(float) for i in (2, 3))
            keep = (np.minimum(na, nb) >= np.maximum(na, nb) * ratio) & (estimate(a, b, na, nb) >= least)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return run


def _judged(pairs: DataFrame, cand: DataFrame, percent: int) -> DataFrame:
    """a, b, linked of the distinct candidate pairs (a, b) that are near: at most twice as far apart as linked ones, on full sets."""
    one, two = (cand.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("registers").alias(f"r{c}"), F.col("shingles").alias(f"s{c}")) for c in "ab")
    sketched = pairs.join(one.drop("sa"), "a").join(two.drop("sb"), "b").select("a", "b", "na", "nb", "ra", "rb")
    close = cut(sketched.mapInArrow(releasing(_promising(percent / 100 - MARGIN, (2 * percent - 100) / 100 - 0.02)), "a long, b long"))
    full = close.join(one.drop("ra"), "a").join(two.drop("rb"), "b").select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("both"))
    full = full.withColumn("union", F.expr("na + nb - both"))
    return full.where(f"100 * both >= {2 * percent - 100} * union").select("a", "b", F.expr(f"100 * both >= {percent} * union").alias("linked"))


def components(links: DataFrame) -> DataFrame:
    """rep and comp, the smallest rep reachable over links (a, b), of all linked reps: minimum labels with pointer jumping."""
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("comp")).withColumnRenamed("a", "rep"))
    while True:
        near = both.join(labels.select(F.col("rep").alias("b"), "comp"), "b").groupBy(F.col("a").alias("rep")).agg(F.min("comp").alias("low"))
        step = labels.join(near, "rep").select("rep", F.col("comp").alias("was"), F.least("comp", "low").alias("mid"))
        far = labels.select(F.col("rep").alias("mid"), F.col("comp").alias("far"))
        jump = cut(step.join(far, "mid").select("rep", "was", F.least("mid", "far").alias("comp")))
        labels = jump.select("rep", "comp")
        if not jump.where("comp <> was").limit(1).count():
            return labels


def _ranked(members: DataFrame) -> DataFrame:
    """Members of bands that are shared, with score: how many members share their bands. The text that copies were made of has the highest."""
    shared = members.join(members.groupBy("band").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "band")
    return cut(shared.join(shared.groupBy("rep").agg(F.sum("m").alias("score")), "rep").select("rep", "band", "score"))


def _with_hubs(members: DataFrame) -> DataFrame:
    """Members with the hub of their band, its member of the highest score, and the number of members."""
    hubs = members.groupBy("band").agg(F.max(F.struct("score", "rep")).alias("top"), F.count(F.lit(1)).alias("all"))
    return members.join(hubs.select("band", F.col("top.rep").alias("hub"), "all"), "band")


def _star(starred: DataFrame) -> DataFrame:
    """Each member with the hub of its band, as pairs a < b."""
    return starred.where("rep <> hub").select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b")).distinct()


def _apart(starred: DataFrame, near: DataFrame, comps: DataFrame) -> DataFrame:
    """Members (band, rep, comp, kind) whose links the comparison with the hub leaves open.

    kind is 2 for the hub and what is linked to it, 1 for what is near it, 0 for what is far. Distance is a metric, so a far
    member can't be linked to one of kind 2; those of kind 2 are one component. They stay only where a near member is of another.
    """
    own = starred.where("all > 2").select("band", "rep", "hub", F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b"))
    own = own.join(near, ["a", "b"], "left").join(comps, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    kind = F.when((F.col("rep") == F.col("hub")) | F.coalesce("linked", F.lit(False)), 2).when(F.col("linked").isNotNull(), 1).otherwise(0)
    own = cut(own.select("band", "rep", "comp", kind.alias("kind")))
    of = lambda k: F.when(F.col("kind") == k, F.col("comp"))
    loose = F.when(F.col("kind") < 2, F.col("comp"))
    bands = own.groupBy("band").agg(F.max(of(2)).alias("h"), F.min(of(1)).alias("n0"), F.max(of(1)).alias("n1"), F.min(loose).alias("u0"), F.max(loose).alias("u1"))
    bands = bands.withColumn("tie", F.coalesce((F.col("n0") != F.col("h")) | (F.col("n1") != F.col("h")), F.lit(False))).where("tie OR u0 < u1")
    return cut(own.join(bands.select("band", "tie"), "band").where("tie OR kind < 2").select("band", "rep", "comp", "kind"))


def _bounds(apart: DataFrame, cand: DataFrame, percent: int) -> DataFrame:
    """Of members that may have a link to another component: rep, n, e (shingles also found in another component) and groups, those counted by group."""
    own = apart.select("rep", "comp").distinct().join(cand.select("rep", "n", "shingles"), "rep")
    items = own.select("rep", "comp", "n", F.explode("shingles").alias("s"))
    across = items.groupBy("s").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("s")
    counts = items.join(across, "s").groupBy("rep", "n", F.pmod("s", F.lit(GROUPS)).cast("int").alias("g")).agg(F.count(F.lit(1)).cast("int").alias("c"))
    whole = counts.groupBy("rep", "n").agg(F.sum("c").alias("e"), F.map_from_entries(F.collect_list(F.struct("g", "c"))).alias("of"))
    groups = F.transform(F.sequence(F.lit(0), F.lit(GROUPS - 1)), lambda g: F.coalesce(F.try_element_at("of", g), F.lit(0)))
    whole = whole.where(f"100 * e >= {percent} * n").select("rep", "n", "e", groups.alias("groups"))
    coarse = [reduce(Column.__add__, [F.get("groups", F.lit(g)) for g in range(k, GROUPS, COARSE)]).alias(f"c{k}") for k in range(COARSE)]
    return cut(whole.select("*", *coarse))


def _possible(apart: DataFrame, bounds: DataFrame, percent: int) -> DataFrame:
    """Pairs a < b of a band, of different components, that the bounds allow to be linked; none of a far member and one linked to the hub."""
    own = apart.join(bounds, "rep")
    x, y = (own.select("band", *[F.col(c).alias(f"{c}_{side}") for c in own.columns if c != "band"]) for side in "ab")
    enough = lambda both: 100 * both >= percent * (F.col("n_a") + F.col("n_b") - both)
    most = F.aggregate(F.zip_with("groups_a", "groups_b", lambda p, q: F.least(p, q)), F.lit(0), lambda t, v: t + v)
    rough = reduce(Column.__add__, [F.least(f"c{k}_a", f"c{k}_b") for k in range(COARSE)])
    apart_kinds = F.abs(F.col("kind_a") - F.col("kind_b")) < 2
    different = (F.col("rep_a") < F.col("rep_b")) & (F.col("comp_a") != F.col("comp_b")) & apart_kinds
    pairs = x.join(y, "band").where(different & enough(F.least("e_a", "e_b")) & enough(rough) & enough(most))  # from the cheapest test to the dearest
    return pairs.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id and kept (it is its component's smallest id)."""
    out = _classes(docs, shingle, percent, id_col, text_col).select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component, of its smallest id; rows with a null id stay, and of each id without words one row."""
    rows = cut(_classes(docs, shingle, percent, id_col, text_col).select("doc", "tag", "least"))
    tag = fresh(docs, "tag")
    own = docs.withColumn(tag, _tag(F.col(text_col)))
    gone = rows.where("doc <> least").select(F.col("doc").alias(f"{tag}_doc"), F.col("tag").alias(f"{tag}_gone")).distinct()
    own = own.join(broadcast_if(gone, BROADCAST_IDS), (own[id_col].cast("long") == F.col(f"{tag}_doc")) & (own[tag] == F.col(f"{tag}_gone")), "left_anti")
    if rows.where("doc IS NOT NULL").groupBy("doc").count().where("count > 1").limit(1).count():  # repeated rows of one document
        named = own.where(F.col(id_col).isNotNull()).dropDuplicates([id_col, tag])
        own = named.unionByName(own.where(F.col(id_col).isNull()))
    return own.drop(tag)


def _tag(text: Column) -> Column:
    return F.crc32(F.coalesce(text.cast("string"), F.lit("")))


def _classes(docs: DataFrame, shingle: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: doc, tag of the text, n and least, the smallest id of the component."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        rows = cut(slim.mapInArrow(releasing(_signatures(shingle, band_size(percent))), "doc long, tag long, n long, k1 long, k2 long, bands array<bigint>"))
    usable = rows.where("n > 0 AND doc IS NOT NULL")
    sets = usable.groupBy("k1", "k2", "n").agg(F.min(F.struct("doc", "tag")).alias("least"), F.first("bands").alias("bands"))
    sets = cut(sets.select(F.monotonically_increasing_id().alias("rep"), "k1", "k2", "n", "least.doc", "least.tag", "bands"))  # the ids hold from here on
    members = _ranked(sets.select("rep", F.explode("bands").alias("band")))
    comps = _linked(members, sets, slim, shingle, percent)
    known = sets.select("k1", "k2", "n", "doc", "rep").join(broadcast_if(comps, BROADCAST_IDS), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    least = known.join(known.groupBy("comp").agg(F.min("doc").alias("least")), "comp").select("k1", "k2", "n", "least")
    out = usable.select("doc", "tag", "k1", "k2", "n").join(least, ["k1", "k2", "n"]).select("doc", "tag", "n", "least")
    return out.union(rows.where("n = 0 OR doc IS NULL").select("doc", "tag", "n", F.col("doc").alias("least")))


def _linked(members: DataFrame, sets: DataFrame, slim: DataFrame, shingle: int, percent: int) -> DataFrame:
    """rep and comp of all sets that are linked to another one."""
    ids = cut(members.select("rep").distinct().join(sets.select("rep", "doc", "tag"), "rep"))
    texts = slim.select("doc", _tag(F.col("text")).alias("tag"), "text").join(broadcast_if(ids, BROADCAST_IDS), ["doc", "tag"]).select("rep", "text")
    with arrow_rows(slim.sparkSession, BATCH_ROWS):
        cand = cut(texts.mapInArrow(releasing(_sketches(shingle)), "rep long, n long, registers array<bigint>, shingles array<bigint>"))
        if cand.count() > ids.count():  # repeated rows of one document
            cand = cut(cand.dropDuplicates(["rep"]))
        starred = cut(_with_hubs(members))
        tested = cut(_star(starred))
        near = cut(_judged(tested, cand, percent))
        comps = components(near.where("linked"))
        apart = _apart(starred, near, comps)
        pairs = cut(_possible(apart, _bounds(apart, cand, percent), percent).join(tested, ["a", "b"], "left_anti"))
        links = _judged(pairs, cand, percent).where("linked").select("a", "b")
        links = cut(links)
    if links.limit(1).count():
        comps = components(comps.select(F.col("rep").alias("a"), F.col("comp").alias("b")).where("a <> b").union(links))
    return comps
