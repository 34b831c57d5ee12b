"""The queries of the numbered operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import cache_folder, count_tokens

    counts = count_tokens(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), cache_path=cache_folder(spark))
    return counts.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_vectors import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import predict_languages

    return predict_languages(_table(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_pages

    return extract_pages(_table(spark, sf_dir, "pages"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_near_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_texts import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import repeats_report

    return repeats_report(_table(spark, sf_dir, "documents"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import round_trip

    return round_trip(_table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nearest import search

    vectors = _table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality

    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversations import damaged, repair_report

    turns = _table(spark, sf_dir, "conversations")
    return repair_report(damaged(turns), ids=turns)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import audit

    return audit(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_near_vectors, op3_language_id, op4_html_text, op5_packing, op6_toxicity, op7_near_texts, op8_repeats, op9_pieces, op10_nearest, op11_quality, op12_conversation_repair, op13_source_divergence)}


def oracle_sql() -> dict[str, str]:
    from .conversations import REPAIR_SQL
    from .divergence import AUDIT_SQL

    return {"op12_conversation_repair": REPAIR_SQL, "op13_source_divergence": AUDIT_SQL}
