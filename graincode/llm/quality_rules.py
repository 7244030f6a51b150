"""Quality rules: a ledger with one failure bit a rule and the measurements behind it.

Method: every rule is evaluated once for every text; the ledger keeps the bits (``fail_bits``) and the measurements. A policy is a
versioned mask over the bits, so verdicts of any policy, and ablations of rules, are bitwise operations on the ledger and never
read a text again.

Defined cases: a null or empty text has no words (it fails the word-count rule); a line without words is never a duplicate line;
a text of fewer than five words has no repeated window; a text of any length is read whole; every input row gives one output row, repeated
rows and null ids too; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import text_batches
from .textnum import Words, blobs_of, ngrams, pieces

SYMBOLS = "#*$%&|<>"
_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS.encode(), dtype=np.uint8))
#: Capitals are A-Z and U+00C0 to U+00DE; letters are A-Z, a-z and all code points from U+00C0.
_CAPITAL = np.isin(np.arange(256), np.arange(ord("A"), ord("Z") + 1))
_LETTER = _CAPITAL | np.isin(np.arange(256), np.arange(ord("a"), ord("z") + 1)) | (np.arange(256) >= 0xC3)
WINDOW = 5

#: Rules by bit: name and SQL over the measurements that is true where the rule fails.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbol_dense", "n_symbols > n_words"),
    ("duplicate_lines", "2 * n_dup_lines > n_lines AND n_dup_lines >= 10"),
    ("long_words", "word_chars > 40 * n_words"),
    ("shouting", "10 * n_upper > 7 * n_letters AND n_letters >= 40"),
    ("exclaiming", "2 * n_exclaim > n_words AND n_words >= 10"),
)
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: Policies by version: the rules that make a text fail.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbol_dense", "duplicate_lines", "long_words", "shouting", "exclaiming"),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_exclaim")


def mask(policy: str) -> int:
    return sum(BITS[name] for name in POLICIES[policy])


def _repeated(words: Words) -> np.ndarray:
    """Words of each text in windows of WINDOW words that occur twice or more in it."""
    n = len(words.hash)
    out = np.zeros(words.texts, dtype=np.int64)
    if n < WINDOW:
        return out
    at = np.flatnonzero(words.doc[: n - WINDOW + 1] == words.doc[WINDOW - 1 :])
    h = ngrams(words.hash, WINDOW)[at]
    order = np.lexsort((h, words.doc[at]))
    h, at = h[order], at[order]
    doc = words.doc[at]
    same = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    twice = np.zeros(len(at), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    edge = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + WINDOW, -1)
    return np.bincount(words.doc[np.cumsum(edge[:-1]) > 0], minlength=words.texts)


def _duplicate_lines(blob: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and all lines with a word."""
    lines = [x for x in blob.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines)), len(lines)


def measure(blobs: list[bytes]) -> dict[str, np.ndarray]:
    words = Words(blobs)
    buf = np.frombuffer(words.raw, dtype=np.uint8)
    head = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))  # code points before each byte
    chars = np.bincount(words.doc, weights=head[words.end] - head[words.start], minlength=words.texts).astype(np.int64)
    lines = [_duplicate_lines(b) for b in blobs]
    first = np.cumsum([0] + [len(b) + 1 for b in blobs[:-1]])
    before = np.concatenate(([0], buf[:-1]))
    capital = _CAPITAL[buf] | ((before == 0xC3) & (buf >= 0x80) & (buf <= 0x9E))

    def total(flags: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flags.astype(np.int64), first)

    return {
        "n_words": words.counts().astype(np.int64),
        "word_chars": chars,
        "n_symbols": total(_SYMBOL[buf]),
        "n_dup_lines": np.array([d for d, _ in lines], dtype=np.int64),
        "n_repeat_words": _repeated(words),
        "n_lines": np.array([n for _, n in lines], dtype=np.int64),
        "n_upper": total(capital),
        "n_letters": total(_LETTER[buf]),
        "n_exclaim": total(buf == ord("!")),
    }


def _run(batches):
    for batch in batches:
        blobs = blobs_of(batch.column(1))
        for a, b in pieces(blobs):
            got = measure(blobs[a:b])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *[pa.array(got[m]) for m in MEASURES]], ["id", *MEASURES])


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, the measurements and fail_bits, a bit for every rule."""
    text_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    measured = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_run, f"id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = " | ".join(f"IF({sql}, {1 << i}L, 0L)" for i, (_, sql) in enumerate(RULES))
    return measured.withColumn("fail_bits", F.expr(bits)).withColumnRenamed("id", id_col)


def apply_policy(led: DataFrame, policy: str, as_col: str = "kept") -> DataFrame:
    """led with as_col: true where no rule of the policy fails."""
    return led.withColumn(as_col, F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0)


def ablations(led: DataFrame, policy: str) -> DataFrame:
    """Per rule of the policy: texts that fail it, and texts that only it removes (they stay if the rule is dropped)."""
    m, aggs = mask(policy), []
    for name in POLICIES[policy]:
        failed = F.col("fail_bits").bitwiseAND(F.lit(m))
        aggs += [F.count_if(failed.bitwiseAND(F.lit(BITS[name])) != 0).alias(f"f_{name}"), F.count_if(failed == BITS[name]).alias(f"o_{name}")]
    one = led.agg(*aggs)
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"f_{n}").alias("failed"), F.col(f"o_{n}").alias("only")) for n in POLICIES[policy]])).alias("r")).select("r.*")
