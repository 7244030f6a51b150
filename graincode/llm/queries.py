"""The registered queries of this subpackage: thin uses of its operators that return digests, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .oracles import SQL
from .runtime import table

VOCABULARY = "byte_bpe_50k.json"

#: The url rules, as action and host with path prefix.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeated_spans

    out = remove_repeated_spans(table(spark, sf_dir, "documents"), window=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_fm import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"), "contaminated")


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import round_trip_digests

    return round_trip_digests(table(spark, sf_dir, "documents"), vocabulary_path())


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=5, percent=85)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import apply_policy, ledger

    led = apply_policy(apply_policy(ledger(table(spark, sf_dir, "documents")), "base", "base_kept"), "v1", "kept")
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("base_kept")).alias("base_failed"), "kept", "fail_bits")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary_path())


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import drop_frequent_lines

    out = drop_frequent_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import integer_vectors, mine

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = integer_vectors(table(spark, sf_dir, "embeddings"), label, F.col("vec_id") % 100 == 0, 256, "vec_id", "embedding")
    return mine(rows, positives=5, negatives=5, floor=80)


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import cut_documents, pack

    return pack(cut_documents(table(spark, sf_dir, "documents"), vocabulary_path(), end_id=2, capacity=1024), 1024)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_substring_dedup, op2_quality_classifier, op3_decontamination, op4_bpe_round_trip, op5_toxicity, op6_minhash_dedup, op7_quality_rules)
    own += (op8_token_counts, op9_line_dedup, op10_url_filter, op11_hard_negatives, op12_best_fit_packing, op13_filter_audit)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if k in queries()}
