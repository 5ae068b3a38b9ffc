"""The corpus pipeline: five operators, each working on all rows that the one before has kept.

Texts are written in small row groups: a stage reads and writes them at once, and with the default size a task
holds two of 128 MB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import stored, table
from tessera.sources.shared import small_groups


def _columns(docs: DataFrame) -> list[str]:
    return [c for c in ("doc_id", "text", "lang", "source", "n_chars") if c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    from tessera.llm import quality_rules as rules

    model = rules.fit(docs, table(small_groups(spark), sf_dir, "labels"))
    return rules.apply(docs, model, keep=_columns(docs)).where("kept").select(*_columns(docs))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from all labelled documents and not only those that came this far, predicts to be good."""
    from tessera.llm import quality_classifier as classifier

    model = classifier.fit(table(small_groups(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return classifier.apply(docs.select(*_columns(docs)), model, whole=True).where("predicted = 1").select(*_columns(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that repeat across documents."""
    from tessera.llm.line_dedup import dedup_lines

    small_groups(spark)
    out = dedup_lines(docs.select(*_columns(docs)))
    out = out.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("kept_text").cast("long"))
    return out.select(*_columns(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that with the smallest doc_id; a repeated row stays once."""
    from tessera.llm.near_dedup import near_dedup as classes

    small_groups(spark)
    kept = classes(docs).where("doc_id <=> class_id").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    out = docs.select(*_columns(docs)).withColumn("__text", F.xxhash64("text"))
    out = out.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__hash")), "left_semi")
    return out.dropDuplicates(["doc_id", "__text"]).select(*_columns(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences; see tessera.llm.packing.SCHEMA."""
    import public_tokenizers

    from tessera.llm.packing import pack

    paths = (public_tokenizers.path(f"byte_bpe_50k.{x}") for x in ("json", "tiktoken"))
    return pack(docs, *paths, public_tokenizers.PATTERN)


STAGES = [("quality_rules", quality_rules), ("quality_classifier", quality_classifier), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("packing", packing)]

#: No SQL: the first two stages are models. tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents; what each returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
