"""Token counts: the tokenizers library in Arrow functions that return lengths only.

Method: texts are cut at safe boundaries (``safe_cuts``); the distinct parts whose length is not known yet are put together to
calls of about ``CALL`` bytes, so that a call's memory depends neither on how long the texts of a batch are nor on how many there
are, and only the lengths of the encodings leave the function. Lengths of up to ``CACHE_PARTS`` parts are remembered. Texts of
any length are counted whole; what has no safe boundary (one word, to the library) is one part, as the library can't split it either.

Defined cases: a null text is an empty one and has no tokens; nothing is truncated; every input row gives one output row, repeated
rows and null ids too; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import releasing, text_batches
from .safe_cuts import parts

#: Bytes of one call, bytes of texts whose parts are held at once, and remembered lengths.
CALL, GROUP, CACHE_PARTS = 1 << 18, 1 << 20, 400_000
_tokenizers: dict = {}


def _tokenizer(path: str):
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.no_truncation()
        own.no_padding()
        _tokenizers[path] = own
    return _tokenizers[path]


def _bytes(text: str | None) -> int:
    return 0 if text is None else len(text) if text.isascii() else len(text.encode())


def _learn(own, known: dict[str, int], new: list[str], before: str) -> None:
    """Encode the new parts in calls balanced by bytes, and keep their lengths."""
    at = 0
    while at < len(new):
        to, size = at, 0
        while to < len(new) and (to == at or size < CALL):
            size += _bytes(new[to])
            to += 1
        for part, e in zip(new[at:to], own.encode_batch_fast([before + p for p in new[at:to]], add_special_tokens=False)):
            known[part] = len(e)
        at = to


class Counter:
    """Token counts by one vocabulary file."""

    def __init__(self, path: str):
        self.own, self.known = _tokenizer(path), {}

    def count(self, texts: list[str | None]) -> list[int]:
        counts, at = [0] * len(texts), 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size < GROUP):
                size += _bytes(texts[to])
                to += 1
            cut = {i: parts(texts[i]) for i in range(at, to) if texts[i]}
            if len(self.known) > CACHE_PARTS:
                self.known = {}
            heads: dict[str, int] = {}
            _learn(self.own, heads, list({c[0] for c in cut.values()}), "")
            _learn(self.own, self.known, list({p for c in cut.values() for p in c[1:]}.difference(self.known)), " ")
            for i, c in cut.items():
                counts[i] = heads[c[0]] + sum(map(self.known.__getitem__, c[1:]))
            at = to
        return counts


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """Per row: id, n_bytes, n_tokens and over_limit (n_tokens > limit)."""

    def run(batches):
        counter = Counter(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counter.count(batch.column(2).to_pylist()), pa.int64())], ["id", "n_bytes", "n_tokens"])

    text_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"))
    out = slim.mapInArrow(releasing(run), f"id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
    return out.withColumnRenamed("id", id_col)
