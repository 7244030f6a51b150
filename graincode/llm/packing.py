"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Method, large-item matching: pieces above a third of the capacity go at most two to a sequence, so they are matched greedily, the largest with the
largest that fits; smaller ones then go, in falling length, to the fullest sequence that has room, and to new ones where none has.
Pieces of one length are alike, so the whole matching is made on the counts by length: at most ``capacity`` numbers, whatever the
rows. It gives runs: from which rank on, pieces of a length go, so many each, to which sequences at which offset. A piece finds its place
by its rank among those of its length, which is its rank in its partition of the stored pieces plus the counts of the
partitions before. No piece is shuffled, none is dropped, and a length that a third of all rows share is no hot key.

Pieces are written once to the shared folder with their ranks; a lost executor rereads or rewrites whole partitions, so ranks stay.

Defined cases: a null text is an empty document, which is its end mark alone; every input row gives its pieces, repeated rows and null ids too;
an empty table gives no rows; texts of any length are encoded whole; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import _byte_letters
from .runtime import broadcast_if, cut, releasing

#: Characters of texts that are held as Python strings at once.
HELD = 1 << 22


class Encoder:
    """Token ids as a byte-level vocabulary file of the tokenizers library gives them.

    If the file's ids follow the ranks of its merges, they are all that a rank-ordered byte pair encoder needs, and tiktoken does
    the same work in a quarter of the time; other files go to the tokenizers library itself.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = {t["content"]: t for t in spec.get("added_tokens", ())}
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"].get(a + b, -1) for a, b in pairs]
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer")
        plain &= made == sorted(set(made)) and not any(t.get(k) for t in added.values() for k in ("lstrip", "rstrip", "single_word"))
        plain &= not model.get("ignore_merges") and not model.get("dropout")
        self.added, self.fast, self.library, self.path = set(added), None, None, path
        if plain:
            import public_tokenizers
            import tiktoken

            byte_of = _byte_letters()
            ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
            special = {content: t["id"] for content, t in added.items()}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None:
            return self.fast.encode_to_numpy(text, allowed_special=self.added)
        if self.library is None:
            from .token_counts import _tokenizer

            self.library = _tokenizer(self.path)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def edges(length: int, capacity: int) -> list[int]:
    """Where the pieces of a document begin, and its end: only documents above the capacity are cut, and only the first piece may be shorter."""
    first = length % capacity or capacity
    return [0, *range(first, length + 1, capacity)] if length > capacity else [0, length]


def cut_documents(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, and with_ids the ids (array<int>)."""
    end = np.array([end_id], dtype=np.uint32)

    def run(batches):
        own = encoder(vocabulary)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                rows, piece, start, length, crc, ids, held, to = [], [], [], [], [], [], 0, at
                while to < batch.num_rows and (to == at or held < HELD):
                    text = batch.column(1)[to].as_py() or ""
                    held += len(text)
                    all_ids = np.concatenate((own(text), end)).astype("<u4")
                    places = edges(len(all_ids), capacity)
                    for n, (a, b) in enumerate(zip(places, places[1:])):
                        rows.append(to)
                        piece.append(n)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(all_ids[a:b].tobytes()))
                    if with_ids:
                        ids.append(all_ids.astype(np.int32))
                    to += 1
                made = [batch.column(0).take(pa.array(rows)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    flat = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
                    made.append(pa.ListArray.from_arrays(pa.array(flat), pa.array(np.concatenate(ids))))
                yield pa.RecordBatch.from_arrays(made, ["id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])
                at = to

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(releasing(run), f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids).withColumnRenamed("id", id_col)


def matching(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, pieces a sequence, first sequence, offset) in order of length and rank, and the number of sequences."""
    left = {n: c for n, c in counts.items() if c}
    if left and not (min(left) >= 1 and max(left) <= capacity):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    rank = dict.fromkeys(left, 0)
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room: groups of sequences, as first number and count
    runs, made = [], 0

    def put(length: int, each: int, first: int, bins: int, offset: int) -> None:
        runs.append((length, rank[length], each, first, offset))
        rank[length] += each * bins
        left[length] -= each * bins
        if capacity - offset - each * length:
            gaps[capacity - offset - each * length].append((first, bins))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for a in large:
        while left[a]:
            mate = next((b for b in large if b <= min(a, capacity - a) and left[b] > (a == b)), None)
            bins = left[a] if mate is None else left[a] // 2 if mate == a else min(left[a], left[mate])
            if mate == a:
                put(a, 2, made, bins, 0)
            else:
                put(a, 1, made, bins, 0)
                if mate is not None:
                    gaps[capacity - a].pop()
                    put(mate, 1, made, bins, a)
            made += bins
    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        for room in range(s, capacity):
            groups, gaps[room] = (gaps[room], []) if left[s] else ([], gaps[room])
            for first, bins in groups:
                each = room // s
                full = min(bins, left[s] // each)
                if full:
                    put(s, each, first, full, capacity - room)
                    first, bins = first + full, bins - full
                if bins and left[s]:
                    put(s, left[s], first, 1, capacity - room)
                    first, bins = first + 1, bins - 1
                if bins:
                    gaps[room].append((first, bins))
        each = capacity // s
        for n, bins in ((each, left[s] // each), (left[s] % each, 1)):
            if n and bins and left[s]:
                put(s, n, made, bins, 0)
                made += bins
    return np.array(sorted(runs), dtype=np.int64).reshape(-1, 5), made


def _numbered(batches):
    """The rank of a row among those of its length in its partition."""
    seen = np.zeros(1, dtype=np.int64)
    for batch in batches:
        length = np.asarray(batch.column("length"))
        if len(length) and length.max() >= len(seen):
            seen = np.concatenate((seen, np.zeros(int(length.max()) + 1 - len(seen), dtype=np.int64)))
        order = np.argsort(length, kind="stable")
        ranked = length[order]
        starts = np.flatnonzero(np.concatenate((np.ones(min(len(ranked), 1), dtype=bool), ranked[1:] != ranked[:-1])))
        sizes = np.diff(np.concatenate((starts, [len(ranked)])))
        nth = np.empty(len(ranked), dtype=np.int64)
        nth[order] = np.arange(len(ranked)) - np.repeat(starts, sizes) + seen[ranked]
        seen[ranked[starts]] += sizes
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nth)], [*batch.schema.names, "nth"])


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces (with length, from 1 to capacity) with sequence_id and offset: as few sequences as the matching makes, no gap before any piece."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    ranked = cut(pieces.mapInArrow(_numbered, f"{kinds}, nth long")).withColumn("_part", F.spark_partition_id())
    counts = cut(ranked.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("n")))
    runs, _ = matching({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)  # at most capacity rows
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    found = ranked.join(broadcast_if(offsets, 500_000), ["_part", "length"])
    shift = np.int64(1 << 44)  # above any rank
    keys = runs[:, 0] * shift + runs[:, 1]
    names = [f.name for f in pieces.schema.fields]

    def place(batches):
        for batch in batches:
            length, nth = np.asarray(batch.column("length")), np.asarray(batch.column("_rank"))
            run = runs[np.searchsorted(keys, length * shift + nth, side="right") - 1]
            row, col = np.divmod(nth - run[:, 1], np.maximum(run[:, 2], 1))
            yield pa.RecordBatch.from_arrays([*batch.select(names).columns, pa.array(run[:, 3] + row), pa.array(run[:, 4] + col * length)], [*names, "sequence_id", "offset"])

    picked = found.select(*[F.col(f"`{n}`") for n in names], (F.col("before") + F.col("nth")).alias("_rank"))
    return picked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def packed_sequences(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per sequence: sequence_id, ids (array<int>) and the offsets at which its pieces begin, in order."""
    placed = pack(cut_documents(docs, vocabulary, end_id, capacity, id_col, text_col, with_ids=True), capacity)
    rows = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("own"))  # capacity ids at most
    return rows.select("sequence_id", F.flatten("own.ids").alias("ids"), F.col("own.offset").alias("offsets"))
