"""Documents with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

from __future__ import annotations

import pytest

GOOD = "The quick brown fox jumps over the lazy dog and then it walks home through the quiet green field near our old river"
NAMES = ("key", "bands", "h1", "h2", "batch", "n", "root", "__text", "__doc", "__drop", "score", "word", "c", "row", "label", "kept", "feature", "__words", "text_hash", "vec")


def awkward() -> list[tuple]:
    """(doc_id, text)"""
    line = "This line of at least forty code points is in many documents"
    prose = [" ".join(f"{GOOD} number {i} {j}" for j in range(4)) for i in range(12)]
    return [
        *((i, prose[i] + "\n" + line) for i in range(8)),
        (20, prose[0] + "\n" + line),  # a copy
        (21, prose[0] + "\n" + line.upper() + "  "),  # a copy but for case
        (21, prose[0] + "\n" + line.upper() + "  "),  # a repeated row
        (22, prose[0].replace("number 0 3", "figure 0 3") + "\n" + line),  # a near copy
        (23, None), (24, ""), (25, "\n\n"), (26, "word"), (None, "no id " + prose[9]), (None, None),
        (27, "Ünïcode ☃ " * 30), (28, "x" * 50_000), (29, "a b " * 30_000), (30, " \t\x0b\x0c\r "), (31, "BUY!! NOW!! | CLICK | " * 40),
    ]


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    """The awkward documents, written as Parquet, with extra columns whose names clash with inner ones."""
    df = spark.createDataFrame([(d, t, "en", "s", None) for d, t in awkward()], "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    df.withColumns({c: F.lit(7) for c in NAMES}).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, 1, 0) for i in range(8)] + [(31, 0, 0), (99, None, None), (None, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
