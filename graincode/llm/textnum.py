"""Vectorised word and n-gram hashing over batches of texts.

A batch of texts is joined into one byte buffer; words are found with one table lookup per byte and hashed with a
prefix-sum polynomial modulo 2**64, so that no Python code runs for a word. Work arrays are bounded by ``PIECE`` bytes of text
(or one word, if that is longer), whatever the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text for which work arrays are held at once.
PIECE = 1 << 20
#: ASCII white space: the separators of ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD1342543DE82EF95
_BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _pow(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 2**64)):
            a = np.full(size, b, dtype=np.uint64)
            a[0] = 1
            both.append(np.multiply.accumulate(a))
        have = _powers[base] = (both[0], both[1])
    return have


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ np.uint64((salt * 0xA24BAED4963EE407 + 0x9FB21C651E98DF25) % 2**64) if salt else x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """Words of a batch: start and end in ``raw``, index of the text, 64-bit hash."""

    __slots__ = ("doc", "end", "hash", "raw", "sizes", "start", "texts")

    def __init__(self, blobs: list[bytes]):
        self.texts = len(blobs)
        self.sizes = [len(b) + 1 for b in blobs]  # bytes, with the separator
        self.raw = b"\n".join(blobs) + b"\n"
        buf = np.frombuffer(self.raw, dtype=np.uint8)
        space = SPACE[buf]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        first = np.cumsum([0] + [len(b) + 1 for b in blobs[:-1]]) if blobs else np.zeros(0, dtype=np.int64)
        self.doc = (np.searchsorted(first, self.start, side="right") - 1).astype(np.int32)
        self.hash = self._hash(buf)

    def _hash(self, buf: np.ndarray) -> np.ndarray:
        n = len(self.start)
        out = np.empty(n, dtype=np.uint64)
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(self.start, self.start[at] + PIECE)))
            lo, hi = int(self.start[at]), int(self.end[to - 1])
            power, inverse = _pow(_BASE, hi - lo)
            run = np.zeros(hi - lo + 1, dtype=np.uint64)
            np.cumsum(_BYTES[buf[lo:hi]] * power[: hi - lo], out=run[1:])
            s, e = self.start[at:to] - lo, self.end[at:to] - lo
            out[at:to] = mix((run[e] - run[s]) * inverse[s])
            at = to
        return out

    def counts(self) -> np.ndarray:
        """Words of each text."""
        return np.bincount(self.doc, minlength=self.texts)


def ngrams(h: np.ndarray, n: int, salt: int = 1) -> np.ndarray:
    """Hash of every n consecutive entries of h (len(h) - n + 1 of them, across texts too)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    power, inverse = _pow(_WORD_BASE, len(h))
    run = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(mix(h, salt + 1) * power[: len(h)], out=run[1:])
    return mix((run[n:] - run[:-n]) * inverse[:m], salt)


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every n consecutive entries, by doubling."""
    if len(x) < n:
        return x[:0]
    have, size = x, 1
    while size * 2 <= n:
        have = np.minimum(have[:-size], have[size:])
        size *= 2
    rest = n - size
    return np.minimum(have[: len(have) - rest], have[rest:]) if rest else have


def blobs_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def pieces(blobs: list[bytes], limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most limit bytes together, one text at least."""
    at, n = 0, len(blobs)
    while at < n:
        to, size = at + 1, len(blobs[at])
        while to < n and size + len(blobs[to]) <= limit:
            size += len(blobs[to])
            to += 1
        yield at, to
        at = to


def slices(batch: pa.RecordBatch, *columns: int, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most limit bytes of text in the given columns, one row at least."""
    size = sum(np.asarray(pc.fill_null(pc.binary_length(batch.column(c)), 0)).astype(np.int64) for c in columns)
    end, at = np.cumsum(size), 0
    while at < batch.num_rows:
        before = int(end[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(end, before + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
