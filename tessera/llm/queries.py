"""The queries of the text operators: each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import table


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tessera.llm.chat_format import mask_text, rotate

    return rotate(table(spark, sf_dir, "conversations")).withColumn("mask", mask_text(F.col("mask")))


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.language_model import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality_classifier import quality_classifier

    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tessera.llm.line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tessera.llm.near_dedup import near_dedup

    out = near_dedup(table(spark, sf_dir, "documents")).drop("text_hash")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_bpe(spark: SparkSession, sf_dir: str, ranks_path: str | None = None) -> DataFrame:
    import public_tokenizers

    from tessera.llm.bpe import encode_documents

    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_documents(table(spark, sf_dir, "documents"), ranks_path, public_tokenizers.PATTERN)


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tessera.llm.embedding_dedup import embedding_dedup

    out = embedding_dedup(table(spark, sf_dir, "embeddings"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op10_packing(spark: SparkSession, sf_dir: str, vocabulary_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    import public_tokenizers

    from tessera.llm.packing import pack

    vocabulary_path = vocabulary_path or public_tokenizers.path("byte_bpe_50k.json")
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    return pack(table(spark, sf_dir, "documents"), vocabulary_path, ranks_path, public_tokenizers.PATTERN)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op")}
