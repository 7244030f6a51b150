"""Byte-level BPE encoding and decoding, as the vocabulary file of the tokenizers library defines it.

Method: a word's symbols form a doubly linked list; a priority queue holds the mergeable neighbour pairs by (merge rank, position)
and entries made stale by an earlier merge are skipped when they come up. Decoding concatenates the vocabulary's byte strings.
Added tokens (such as an end-of-text marker) that occur in a text become their own id, as the library does by default.

Texts are taken apart at safe cuts, and what a part comes to (its ids; for digests also their decimal form and the decoded bytes) is
kept in a cache of two bounded generations, so that the queue runs for new parts only and memory does not follow the size of the
vocabulary of a corpus.

Defined cases: nothing is truncated, a text of any length is encoded whole; a null text is an empty one and has no tokens; every input
row gives one output row, repeated rows and null ids too; an empty table gives no rows; other columns are not read, and the functions that return
them replace those named like a result.
"""

from __future__ import annotations

import gc
import hashlib
import json
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import releasing, text_batches
from .safe_cuts import parts

#: Fixed value of the byte-level format: how text is split into words before merging.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Parts in each of the two cache generations: of digests (some 300 bytes each) and of ids. A Python worker keeps them from task to task.
CACHE_WORDS, CACHE_IDS = 400_000, 50_000


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = {chr(b): b for b in plain}, 0
    for b in range(256):
        if chr(b) not in out or out[chr(b)] != b:
            out[chr(256 + extra)] = b
            extra += 1
    return out


_EMPTY = hashlib.sha256(b"").hexdigest()


def _joined(values: list[tuple[int, bytes, bytes]]) -> tuple[int, bytes, bytes]:
    n, ids, strings = zip(*values)
    return sum(n), b",".join(ids), b"".join(strings)


class Memo(dict):
    """What parts between safe cuts come to, made on demand, in two bounded generations. A part stands for itself with a space before it."""

    def __init__(self, own: "Codec", value: Callable, joined: Callable, size: int):
        super().__init__()
        self.own, self.value, self.joined, self.size, self.old, self.others = own, value, joined, size, {}, {}

    def __missing__(self, part: str):
        got = self.old.get(part)
        if got is None:
            plain = part.isalpha() and not self.own.lettered  # one word
            got = self.value(self.own.merge((" " + part).encode())) if plain else self.whole(" " + part)
        if len(part) <= 64:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[part] = got
        return got

    def whole(self, text: str):
        """What any text comes to, word by word."""
        own = self.own
        if own.special is None or not any([t in text for t in own.added]):
            return self._words(own.words(text))
        pieces = [self.value((own.added[x],)) if x in own.added else self._words(own.words(x)) for x in own.special(text) if x]
        return self.joined(pieces)

    def _words(self, words: list[str]):
        got = [self[w[1:]] if w[0] == " " and w[1:].isalpha() and not self.own.lettered else self._other(w) for w in words]
        return got[0] if len(got) == 1 else self.joined(got) if got else self.value(())

    def _other(self, word: str):
        got = self.others.get(word)
        if got is None:
            got = self.value(self.own.merge(word.encode()))
            if len(word) <= 64:
                if len(self.others) >= self.size:
                    self.others = {}
                self.others[word] = got
        return got


class Codec:
    """Vocabulary, merges and added tokens of one file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = _byte_letters()
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        vocab = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.added}
        self.strings: list[bytes] = [b""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for token, i in vocab.items():
            self.strings[i] = token
        for token, i in self.added.items():
            self.strings[i] = token.encode()
        self.of_byte = [vocab[bytes([b])] for b in range(256)]
        none: dict[int, int] = {}
        self.after = [none] * len(self.strings)  # by left id: the rank of its merge with each right id
        self.lefts, self.rights, self.made = [], [], []  # ids of a merge, by rank
        for pair in spec["model"]["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b = (bytes(byte_of[c] for c in part) for part in (left, right))
            if self.after[vocab[a]] is none:
                self.after[vocab[a]] = {}
            self.after[vocab[a]].setdefault(vocab[b], len(self.made))
            self.lefts.append(vocab[a])
            self.rights.append(vocab[b])
            self.made.append(vocab[a + b])
        self.first = [self.after[a].get(b, -1) for a in self.of_byte for b in self.of_byte]  # ranks of pairs of bytes
        self.words = regex.compile(WORD_PATTERN).findall
        self.special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")").split if self.added else None
        self.lettered = any(t.isalpha() for t in self.added)  # then words of letters may hold an added token
        self.ids = Memo(self, tuple, lambda values: tuple(chain.from_iterable(values)), CACHE_IDS)
        names = [str(i).encode() for i in range(len(self.strings))].__getitem__
        strings = self.strings.__getitem__
        self.digests = Memo(self, lambda ids: (len(ids), b",".join(map(names, ids)), b"".join(map(strings, ids))), _joined, CACHE_WORDS)

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Token ids of one word. Queue entries are the merge's rank, shifted, and the position of the left symbol."""
        n = len(word)
        symbol = [*map(self.of_byte.__getitem__, word), -1]
        shift, queue, first = n.bit_length(), [], self.first
        for i, pair in enumerate(zip(word, word[1:])):
            r = first[pair[0] << 8 | pair[1]]
            if r >= 0:
                queue.append(r << shift | i)
        if not queue:
            return tuple(symbol[:n])
        mask, after, lefts, rights, made = (1 << shift) - 1, self.after, self.lefts, self.rights, self.made
        heapify(queue)
        left, right = list(range(-1, n)), list(range(1, n + 2))
        while queue:
            entry = heappop(queue)
            i, merge = entry & mask, entry >> shift
            j = right[i]
            if symbol[i] != lefts[merge] or symbol[j] != rights[merge]:
                continue  # stale: one of the two was merged meanwhile
            symbol[i] = m = made[merge]
            symbol[j] = -1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (r := after[m].get(symbol[k])) is not None:
                    heappush(queue, r << shift | i)
            h = left[i]
            if h >= 0 and (r := after[symbol[h]].get(m)) is not None:
                heappush(queue, r << shift | h)
        return tuple([s for s in symbol if s >= 0])

    def encode(self, text: str) -> list[int]:
        first, *rest = parts(text)
        return [*self.ids.whole(first), *chain.from_iterable(map(self.ids.__getitem__, rest))]

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, SHA-256 of the comma-joined ids and of the text decoded from them."""
        if not text:
            return 0, _EMPTY, _EMPTY
        first, *rest = parts(text)
        n, ids, strings = _joined([self.digests.whole(first), *map(self.digests.__getitem__, rest)])
        return n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(strings.decode("utf-8", errors="replace").encode()).hexdigest()

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", errors="replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each file and Python worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


@contextmanager
def _no_collection() -> Iterator[None]:
    """Values of caches hold no cycles, and looking for some in large caches takes long; after the task the worker collects again."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def _with(df: DataFrame, source: str, as_col: str, kind: str, make: Callable, as_string: bool) -> DataFrame:
    """df with as_col (in place of one of that name): make gives a function of the column source of a batch."""
    kept = [f for f in df.schema.fields if f.name.lower() != as_col.lower()]
    n, read = len(kept), F.col(f"`{source}`")  # what is read goes last, whatever it is called

    def run(batches):
        of = make()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], of(batch.column(n))], [*[f.name for f in kept], as_col])

    text_batches(df.sparkSession)
    picked = df.select(*[F.col(f"`{f.name}`") for f in kept], (read.cast("string") if as_string else read).alias("_read"))
    return picked.mapInArrow(releasing(run), _schema(kept, f"`{as_col}` {kind}"))


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text", as_col: str = "ids") -> DataFrame:
    """docs with the token ids of text_col as an array<int> column."""

    def make():
        own = codec(vocabulary)
        return lambda column: pa.array([own.encode(t or "") for t in column.to_pylist()], pa.list_(pa.int32()))

    return _with(docs, text_col, as_col, "array<int>", make, True)


def decode(tokens: DataFrame, vocabulary: str, ids_col: str = "ids", as_col: str = "decoded") -> DataFrame:
    """tokens with the text of ids_col as a string column; null ids give an empty text."""

    def make():
        own = codec(vocabulary)
        return lambda column: pa.array([own.decode(ids or ()) for ids in column.to_pylist()], pa.string())

    return _with(tokens, ids_col, as_col, "string", make, False)


def round_trip_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, and SHA-256 of the comma-joined ids and of the text decoded from them.

    Encodes and decodes text by text, so that no batch of id lists has to be held or sent to the JVM.
    """

    def run(batches):
        own = codec(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # few texts as Python strings at once
                part = batch.slice(at, 256)
                with _no_collection():
                    n, enc, dec = zip(*[own.digest(text or "") for text in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(enc, pa.string()), pa.array(dec, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    text_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(releasing(run), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)


def encode_checked(docs: DataFrame, vocabulary: str, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with n_tokens, ids (array<int>) and round_trip (whether decoding the ids gives the text again), which replace columns of these names.

    Without keep_text the text goes to Python once and does not come back.
    """
    text_batches(docs.sparkSession)
    gone = {"n_tokens", "ids", "round_trip"} | (set() if keep_text else {text_col.lower()})
    kept = [f for f in docs.schema.fields if f.name.lower() not in gone]
    text, n = F.col(f"`{text_col}`").cast("string").alias("_text"), len(kept)  # the text to encode goes last, whatever it is called

    def run(batches):
        own = codec(vocabulary)
        for batch in batches:
            texts = batch.column(n)
            at = 0
            while at < len(texts):
                to, size, flat, edge, same = at, 0, [], [0], []
                with _no_collection():
                    while to < len(texts) and (to == at or size < 1 << 20):
                        text = texts[to].as_py() or ""
                        ids = own.encode(text)
                        same.append(own.decode(ids) == text)
                        flat.append(np.array(ids, dtype=np.int32))
                        edge.append(edge[-1] + len(ids))
                        size += len(text)
                        to += 1
                lists = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(np.concatenate(flat)))
                made = [pa.array(np.diff(edge).astype(np.int64)), lists, pa.array(same)]
                yield pa.RecordBatch.from_arrays([*batch.slice(at, to - at).columns[:n], *made], [*[f.name for f in kept], "n_tokens", "ids", "round_trip"])
                at = to

    return docs.select(*[F.col(f"`{f.name}`") for f in kept], text).mapInArrow(releasing(run), _schema(kept, "n_tokens long, ids array<int>, round_trip boolean"))


def _schema(fields, more: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [more])
