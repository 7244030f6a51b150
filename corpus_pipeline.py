"""A training-data pipeline of five stages. Each takes (spark, docs, sf_dir) and works on all rows its predecessor kept.

quality: documents that the classifier rejects (score under 0.3) leave. lines: lines found in ten documents or more leave, text
and n_chars follow (a null text stays null). near_dedup: one document of each group of near duplicates stays, the one of the
smallest id; near means that the sets of five-word shingles have a Jaccard similarity of 0.8 or more. decontaminate: documents
that hold a window of ten words of the benchmark leave. tokens: n_tokens, byte-level BPE ids and whether they decode to the text
(round_trip) take the place of the text, and of columns of these names; all other columns stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graincode.llm.bpe import encode_checked
from graincode.llm.decontaminate import drop_contaminated
from graincode.llm.line_dedup import drop_frequent_lines
from graincode.llm.minhash_dedup import keep_one
from graincode.llm.quality_fm import learn, score
from graincode.llm.queries import vocabulary_path
from graincode.llm.runtime import cut, fresh, table

#: Python models decide in two stages, which SQL cannot express.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    machine, own = learn(docs, table(spark, sf_dir, "labels")), fresh(docs, "score")
    return score(docs, machine, as_col=own).where(F.col(own) >= 0.3).drop(own)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = fresh(docs, "lines")
    kept, gone = F.col(f"{own}_kept"), F.col(f"{own}_gone")
    out = drop_frequent_lines(docs, min_docs=10, min_chars=1, kept_col=f"{own}_kept", lines_col=f"{own}_all", dropped_col=f"{own}_gone")
    text = F.when(F.col("text").isNotNull(), kept)
    length = F.when(gone > 0, F.char_length(kept).cast("long")).otherwise(F.col("n_chars"))
    return out.select(*[{"text": text, "n_chars": length}.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs, shingle=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"), window=10)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_checked(docs, vocabulary_path(), keep_text=False)


STAGES = [("quality", quality), ("lines", lines), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
