"""The pipeline's stages write whole texts in small row groups: with large ones a task that reads and writes them runs out of memory."""

from __future__ import annotations

import random
from pathlib import Path

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from tessera.sources.shared import ROW_GROUP


@pytest.mark.parametrize("stage", ["quality_rules", "quality_classifier"])
def test_texts_are_written_in_small_row_groups(spark, tmp_path, stage):
    rng = random.Random(5)
    rows = [(i, " ".join(f"{rng.getrandbits(48):x}" for _ in range(1600)), "en", "s", 0) for i in range(2400)]  # 50 MB of text
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(-1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    before = spark.conf.get("parquet.block.size", None)
    spark.conf.unset("parquet.block.size")
    try:
        docs = spark.read.parquet(f"{tmp_path}/documents.parquet").coalesce(1)
        getattr(corpus_pipeline, stage)(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    finally:
        spark.conf.unset("parquet.block.size")
        if before:
            spark.conf.set("parquet.block.size", before)
    files = [pq.ParquetFile(p).metadata for p in Path(f"{tmp_path}/out").glob("*.parquet")]
    assert sum(f.num_rows for f in files) == len(rows)
    assert max(f.row_group(k).total_byte_size for f in files for k in range(f.num_row_groups)) < 1.25 * ROW_GROUP
