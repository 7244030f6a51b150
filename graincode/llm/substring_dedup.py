"""Substring dedup: words in long passages that also start in a document with a smaller id are removed.

Method: Count-min prefilter. Every window of ``window`` words is represented by its anchor, the smallest hash of the
``ANCHOR`` consecutive words in it. Equal windows have equal anchors, so the number of times an anchor is met is never less than
the number of documents that hold any of its windows. The sketch is cut by range of hashes: a range is a Count-min sketch of
``SKETCH_ROWS`` rows of at most ``2**RANGE_BITS`` cells. Each partition counts its anchors in a sketch of its own, which names the cells
that it has met; the sketches of all partitions are merged on the executors, range by range, and cells counted twice or more remain
as bits. A second pass groups, by a 96-bit hash of all ``window`` words, exactly those windows whose anchor is estimated as repeated:
collisions in the sketch only add candidates, none is lost. A row has at least four cells for each anchor, so that at most one
unrepeated anchor in 400 passes.

Anchors are always estimated by the merged sketch. Up to ``MAX_BITS`` cells a row it goes to all executors (32 MB). Beyond that
its ranges stay where they are: the distinct anchors of each text are dealt by range, each range's bits come first and its anchors
stream past them, and a range that a common passage makes large is dealt to several tasks, each with a copy of the bits. Texts then
meet the list of their own estimated anchors. A worker holds one range (16 MB of counts, 2 MB of bits) at any size of the input.

Windows that very many documents hold are few; their first documents are broadcast, so that no task reads all rows of one of them.

Defined cases: a null text has no words; a text shorter than the window, and an empty one, loses nothing; a row with a null
id neither loses words nor makes others lose them; rows that share an id never act on each other, and every input row gives one
output row; a window repeated only inside one document stays; a text of any length is read whole; an empty table gives no rows. Columns other than the id and
the text, whatever their names, are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut, releasing, text_batches
from .textnum import Words, blobs_of, mix, ngrams, signed, slices, sliding_min

ANCHOR = 10
SKETCH_ROWS = 4
#: Cells of a row, as powers of two: at least, at most where the sketch is broadcast, and of one range.
MIN_BITS, MAX_BITS, RANGE_BITS = 16, 26, 22
#: Anchors that a partition counts before it gives its cells away, and that one task meets with the bits of a range.
PART, DEAL = 1 << 20, 1 << 22
#: A window that fills more rows than this, or than a millionth of the windows that texts of this size can have, is broadcast.
HOT_ROWS, HOT_KEYS = 10_000, 1_000_000


def _anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows that lie in one text, and the anchor of each."""
    k = min(ANCHOR, window)
    if len(words.hash) < window:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    low = sliding_min(ngrams(words.hash, k), window - k + 1)
    at = np.flatnonzero(words.doc[: len(low)] == words.doc[window - 1 :])
    return at, low[at]


def _range_bits(bits: int) -> int:
    return min(bits, RANGE_BITS)


def _range_of(anchor: np.ndarray, bits: int) -> np.ndarray:
    """The range of hashes that an anchor belongs to."""
    over = bits - _range_bits(bits)
    return (mix(anchor, 97) >> np.uint64(64 - over)).astype(np.int64) if over else np.zeros(len(anchor), dtype=np.int64)


def _cell_of(anchor: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The cell of an anchor within its range, rows one after the other."""
    size = _range_bits(bits)
    return (mix(anchor, 101 + row) >> np.uint64(64 - size)).astype(np.int64) + (row << size)


def _runs(batches, window: int):
    """The anchors of texts; one counts once for the run of windows that share it."""
    for part in (x for batch in batches for x in slices(batch, 0)):
        words = Words(blobs_of(part.column(0)))
        at, anchor = _anchors(words, window)
        doc = words.doc[at]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
        yield anchor[new]


def _met_cells(anchor: np.ndarray, bits: int):
    """Of each range: its number, the cells that these anchors meet (twice or more: an odd number), and how many anchors it has."""
    width = SKETCH_ROWS << _range_bits(bits)
    ranges = _range_of(anchor, bits)
    cells, n = np.unique(np.concatenate([ranges * width + _cell_of(anchor, row, bits) for row in range(SKETCH_ROWS)]), return_counts=True)
    of = cells // width
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    numbers, sizes = np.unique(ranges, return_counts=True)
    for number, size, part in zip(numbers.tolist(), sizes.tolist(), np.split(np.arange(len(cells)), first[1:])):
        yield number, (cells[part] % width) * 2 + (n[part] > 1), size


def _partial_sketch(bits: int, anchors):
    """The sketch of one partition, range by range; ``anchors`` gives arrays of anchors from its batches."""

    def rows(held):
        number, cells, size = [], [], []
        for r, met, n in _met_cells(np.concatenate(held), bits):
            number.append(r)
            cells.append(zlib.compress(np.diff(met, prepend=0).astype(np.uint32).tobytes(), 1))
            size.append(n)
        return pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(cells, pa.binary()), pa.array(size, pa.int64())], ["range", "cells", "n"])

    def run(batches):
        held, n = [], 0
        for some in anchors(batches):
            for lo in range(0, len(some), PART):
                held.append(some[lo : lo + PART])
                n += len(held[-1])
                if n >= PART:
                    yield rows(held)
                    held, n = [], 0
        if n:
            yield rows(held)

    return run


def _merge(bits: int):
    """Merges sketches that come sorted by range, one running sum at a time: bits of the cells that were met twice or more."""

    def done(number, total, n):
        packed = zlib.compress(np.packbits(total >= 2).tobytes(), 1)
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([packed], pa.binary()), pa.array([n], pa.int64())], ["range", "cells", "n"])

    def run(batches):
        at, total, n = None, None, 0
        for batch in batches:
            for number, cells, size in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                if number != at:
                    if total is not None:
                        yield done(at, total, n)
                    at, total, n = number, np.zeros(SKETCH_ROWS << _range_bits(bits), dtype=np.uint8), 0
                met = np.cumsum(np.frombuffer(zlib.decompress(cells.as_py()), dtype=np.uint32).astype(np.int64))
                cell = met >> 1
                total[cell] = np.minimum(total[cell] + 1 + (met & 1), 2)
                n += size
        if total is not None:
            yield done(at, total, n)

    return run


def text_size(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def sketch_bits(size: int, window: int) -> int:
    """Cells of a row of the sketch, as a power of two: four for each anchor that texts of this size have, at least."""
    anchors = size / 6 * 2 / (window - min(ANCHOR, window) + 2)
    return max(MIN_BITS, int(np.ceil(np.log2(4 * anchors + 1))))


def merged_sketch(docs: DataFrame, anchors, bits: int) -> DataFrame:
    """The merged sketch, a row for each range: its bits, and how many anchors it has counted.

    The ranges of all partitions stream, sorted, through the merge, which holds one of them however many partitions there are.
    """
    kind = "range int, cells binary, n long"
    partial = docs.mapInArrow(releasing(_partial_sketch(bits, anchors)), kind)
    return partial.repartition("range").sortWithinPartitions("range").mapInArrow(releasing(_merge(bits)), kind)


def gathered(merged: DataFrame, bits: int) -> np.ndarray:
    """The merged sketch as one array of bits, for a broadcast. At most SKETCH_ROWS * 2**MAX_BITS / 8 bytes (32 MB) come to the driver."""
    out = np.zeros((1 << (bits - _range_bits(bits)), (SKETCH_ROWS << _range_bits(bits)) // 8), dtype=np.uint8)
    for row in merged.select("range", "cells").toLocalIterator():
        out[row["range"]] = np.frombuffer(zlib.decompress(bytes(row["cells"])), dtype=np.uint8)
    return out


def _twice(sketch: np.ndarray, anchor: np.ndarray, ranges, bits: int) -> np.ndarray:
    """Whether anchors are met twice or more, by the bits of their ranges (one row of ``sketch`` each)."""
    hit = np.ones(len(anchor), dtype=bool)
    for row in range(SKETCH_ROWS):
        cell = _cell_of(anchor, row, bits)
        hit &= (sketch[ranges, cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
    return hit


def _met(bits: int, shared):
    """Whether anchors are met twice or more, by the sketch that all executors have. The second argument of what is returned is not used."""

    def of(anchor: np.ndarray, _):
        sketch = np.frombuffer(shared.value, dtype=np.uint8).reshape(1 << (bits - _range_bits(bits)), -1)
        return _twice(sketch, anchor, _range_of(anchor, bits), bits)

    return of


def _listed(anchor: np.ndarray, anchors: pa.ListArray):
    """Whether anchors are among those of the texts' own lists. One text may take another's: that only adds candidates."""
    return np.isin(anchor, np.asarray(anchors.flatten()).view(np.uint64))


def _candidates(words: Words, window: int, met, lists) -> np.ndarray:
    """Starts of the windows that the sketch estimates as repeated."""
    at, anchor = _anchors(words, window)
    return at[met(anchor, lists)]


def _own_anchors(window: int, bits: int):
    """Of each text the distinct anchors, as (doc, tag, anchor, range)."""

    def run(batches):
        for part in (x for batch in batches for x in slices(batch, 1)):
            blobs = blobs_of(part.column(1))
            words = Words(blobs)
            at, anchor = _anchors(words, window)
            doc = words.doc[at]
            order = np.lexsort((anchor, doc))
            doc, anchor = doc[order], anchor[order]
            new = np.ones(len(at), dtype=bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
            tag = np.array([_tag(x) for x in blobs], dtype=np.int64)
            ids = part.column(0).take(pa.array(doc[new]))
            out = [ids, pa.array(tag[doc[new]], pa.int64()), pa.array(signed(anchor[new])), pa.array(_range_of(anchor[new], bits), pa.int32())]
            yield pa.RecordBatch.from_arrays(out, ["doc", "tag", "anchor", "range"])

    return run


def _plain(batches):
    """Anchors from a column of them."""
    for batch in batches:
        yield np.asarray(batch.column(0)).view(np.uint64)


def _past_bits(bits: int):
    """Of rows sorted by range, its bits before its anchors: the anchors that are estimated as repeated."""

    def run(batches):
        bitmap = np.zeros((1, (SKETCH_ROWS << _range_bits(bits)) // 8), dtype=np.uint8)
        for batch in batches:
            comes = np.flatnonzero(np.asarray(batch.column(0).is_valid()))
            edges = [0, *comes.tolist(), len(batch)]
            for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
                if i:  # this piece starts with the bits of a range
                    bitmap = np.frombuffer(zlib.decompress(batch.column(0)[lo].as_py()), dtype=np.uint8).reshape(1, -1)
                    lo += 1
                if lo == hi:
                    continue
                piece = batch.slice(lo, hi - lo)
                met = _twice(bitmap, np.asarray(piece.column(3)).view(np.uint64), 0, bits)
                yield pa.RecordBatch.from_arrays([piece.column(c).filter(pa.array(met)) for c in (1, 2, 3)], ["doc", "tag", "anchor"])

    return run


def _estimated(slim: DataFrame, window: int, bits: int) -> DataFrame:
    """doc, tag and anchor of all anchors of texts that the merged sketch, dealt by range, estimates as repeated."""
    own = cut(slim.where("doc IS NOT NULL").mapInArrow(releasing(_own_anchors(window, bits)), "doc long, tag long, anchor long, range int"))
    sketch = cut(merged_sketch(own.select("anchor"), _plain, bits))
    # at most one range in DEAL anchors is dealt to several tasks: 12 bytes for some 500 MB of text
    large = sketch.where(F.col("n") > DEAL).select(F.col("range").alias("large"), F.ceil(F.col("n") / DEAL).cast("int").alias("tasks"))
    tasks = F.coalesce("tasks", F.lit(1))
    dealt = own.join(F.broadcast(large), F.col("range") == F.col("large"), "left")
    dealt = dealt.select("range", F.pmod(F.xxhash64("doc", "tag"), tasks).cast("int").alias("task"), F.lit(None).cast("binary").alias("cells"), "doc", "tag", "anchor")
    none = F.lit(None).cast("long")
    copies = sketch.select("range", F.explode(F.sequence(F.lit(0), F.ceil(F.greatest("n", F.lit(1)) / DEAL).cast("int") - 1)).alias("task"), "cells", none.alias("doc"), none.alias("tag"), none.alias("anchor"))
    rows = copies.unionByName(dealt).repartition("range", "task").sortWithinPartitions("range", "task", F.col("cells").isNull())
    return rows.select("cells", "doc", "tag", "anchor").mapInArrow(releasing(_past_bits(bits)), "doc long, tag long, anchor long")


def _with_lists(slim: DataFrame, window: int, bits: int) -> DataFrame:
    """doc, text and the text's estimated anchors. All that is made of it reads one exchange of the texts."""
    lists = cut(_estimated(slim, window, bits).groupBy(F.col("doc").alias("_doc"), F.col("tag").alias("_tag")).agg(F.collect_set("anchor").alias("anchors")))
    tagged = slim.withColumn("tag", F.crc32(F.coalesce("text", F.lit(""))))
    both = tagged.join(lists, (F.col("doc") == F.col("_doc")) & (F.col("tag") == F.col("_tag")), "left")
    return both.select("doc", "text", F.coalesce("anchors", F.expr("CAST(array() AS array<bigint>)")).alias("anchors"))


def _tag(blob: bytes) -> int:
    """Tells apart texts that share an id."""
    return zlib.crc32(blob)


def _windows(window: int, met):
    """Of each candidate window: 96 bits of hash, document, and position packed with the text's tag."""

    def run(batches):
        for part in (x for batch in batches for x in slices(batch, 1)):
            ids, blobs = np.asarray(part.column(0).fill_null(0)), blobs_of(part.column(1))
            words = Words(blobs)
            at = _candidates(words, window, met, part.column(2))
            at = at[np.asarray(part.column(0).is_valid())[words.doc[at]]]
            if not len(at):
                continue
            doc = words.doc[at]
            first = np.searchsorted(words.doc, np.arange(len(blobs)))
            tag = np.array([_tag(x) for x in blobs], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(signed(ngrams(words.hash, window, 11)[at])),
                    pa.array((ngrams(words.hash, window, 23)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                    pa.array(ids[doc].astype(np.int64)),
                    pa.array((tag[doc] << 31) | (at - first[doc])),
                ],
                ["h", "g", "doc", "at"],
            )

    return run


def _split(window: int, met, repeated: bool):
    """Rows that have candidate windows (with their text), or the finished rows of those that have none."""

    def run(batches):
        for part in (x for batch in batches for x in slices(batch, 1)):
            blobs = blobs_of(part.column(1))
            words = Words(blobs)
            touched = np.zeros(len(blobs), dtype=bool)
            touched[words.doc[_candidates(words, window, met, part.column(2))]] = True
            touched &= ~np.asarray(part.column(0).is_null())
            keep = np.flatnonzero(touched == repeated)
            ids = part.column(0).take(pa.array(keep))
            if repeated:
                rest = [pa.array([_tag(blobs[i]) for i in keep], pa.int64()), pa.array([blobs[i] for i in keep], pa.binary())]
                yield pa.RecordBatch.from_arrays([ids, *rest], ["doc", "tag", "blob"])
            else:
                text = pa.array([b" ".join(blobs[i].split()) for i in keep], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([ids, pa.array(words.counts()[keep].astype(np.int64)), pa.array(np.zeros(len(keep), dtype=np.int64)), text], ["doc", "n_words", "n_removed", "kept_text"])

    return run


def _gone(windows: DataFrame, hot_rows: int) -> DataFrame:
    """Windows that start in a document with a smaller id too: doc, tag, at.

    A window of more than ``hot_rows`` rows is joined by broadcast (there are at most HOT_KEYS of them, 24 bytes each); its rows go on under
    keys of their own, so that they spread.
    """
    met = windows.groupBy("h", "g").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count(F.lit(1)).alias("n")).where("least < most")
    hot = met.where(F.col("n") > hot_rows).select("h", "g", F.col("least").alias("first"))
    rest = met.where(F.col("n") <= hot_rows).select("h", "g", "least")
    told = F.col("first").isNotNull()
    rows = windows.join(F.broadcast(hot), ["h", "g"], "left").select(
        F.when(told, F.xxhash64("doc", "at")).otherwise(F.col("h")).alias("h"), F.when(~told, F.col("g")).alias("g"), "doc", "at", "first"
    )
    gone = rows.join(rest, ["h", "g"], "left").where(F.col("doc") > F.coalesce("first", "least"))
    return gone.select("doc", F.shiftright("at", 31).alias("tag"), F.col("at").bitwiseAND((1 << 31) - 1).cast("int").alias("at"))


def _remove(window: int):
    def run(batches):
        for part in (x for batch in batches for x in slices(batch, 1)):
            n, gone, text = [], [], []
            for blob, starts in zip(part.column(1).to_pylist(), part.column(2)):
                words = (blob or b"").split()
                edge = np.zeros(len(words) + 1, dtype=np.int32)
                if starts.is_valid:
                    at = np.unique(np.asarray(starts.values, dtype=np.int64))
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                n.append(len(words))
                gone.append(len(words) - len(kept))
                text.append(b" ".join([words[i] for i in kept.tolist()]))
            out = [part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(text, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(out, ["doc", "n_words", "n_removed", "kept_text"])

    return run


def remove_repeated_spans(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, n_words, n_removed and kept_text (the words that stay, joined by one space)."""
    text_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    size = text_size(slim, "text")
    bits = sketch_bits(size, window)
    if bits <= MAX_BITS:
        sketch = gathered(merged_sketch(slim.select("text"), lambda batches: _runs(batches, window), bits), bits)
        met = _met(bits, docs.sparkSession.sparkContext.broadcast(sketch.tobytes()))
        texts = slim.withColumn("anchors", F.expr("CAST(NULL AS array<bigint>)"))
    else:
        met, texts = _listed, _with_lists(slim, window, bits)
    windows = texts.mapInArrow(releasing(_windows(window, met)), "h long, g int, doc long, at long")
    gone = _gone(windows, max(HOT_ROWS, size // 2 // HOT_KEYS))
    starts = gone.groupBy("doc", "tag").agg(F.collect_list("at").alias("starts"))
    touched = texts.mapInArrow(releasing(_split(window, met, True)), "doc long, tag long, blob binary")
    out = "doc long, n_words long, n_removed long, kept_text string"
    removed = touched.join(starts, ["doc", "tag"], "left").select("doc", "blob", "starts").mapInArrow(releasing(_remove(window)), out)
    finished = texts.mapInArrow(releasing(_split(window, met, False)), out)
    return finished.unionByName(removed).withColumnRenamed("doc", id_col)
