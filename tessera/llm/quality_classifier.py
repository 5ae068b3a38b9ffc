"""Quality classifier: which of two zstandard dictionaries compresses a text better.

One dictionary is built from labelled good text, the other from labelled bad text. A text's feature is
(bytes with the bad one - bytes with the good one) / bytes of the text; logistic regression on labelled
rows that are in neither dictionary turns it into the probability of label 1.

Only labelled rows outside the held-out fold (crc32(doc_id) mod 5 = 0) are learnt from, in a bounded sample:
about PER_CLASS rows of a label, chosen by hash of doc_id, of which at most half go into the dictionary. Every
text is scored whole.

Cases: a null text counts as empty; empty texts have the feature 0. Rows with the same doc_id are scored one
by one; the least of their texts is learnt from. Without labelled text of both kinds, two rows each, the score is the share of label 1 among the rows learnt from,
with one added to each count. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fold, hash_sample, stored

#: Labelled rows of each label that are learnt from, about, if there are more; one in SHARE of them, and at most IN_DICTIONARY, is for the
#: dictionary, the others are to calibrate: some of either label at every size.
PER_CLASS, IN_DICTIONARY, SHARE = 4000, 1000, 2
#: Most bytes of a dictionary, and most characters of a text that goes into one.
DICTIONARY_BYTES, LONGEST = 512 << 10, 20_000
LEVEL = 9
#: Documents with at least this score are predicted good; fixed by the contract.
CUT = 0.3
SPLIT = 5


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float


def _features(texts: list[bytes], good: bytes, bad: bytes) -> np.ndarray:
    def sizes(content: bytes) -> list[int]:
        book = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        c = zstandard.ZstdCompressor(level=LEVEL, dict_data=book, write_checksum=False, write_content_size=False)
        return [len(c.compress(x)) if x else 0 for x in texts]

    if not good or not bad:
        return np.zeros(len(texts))
    lengths = np.array([max(1, len(x)) for x in texts], float)
    return (np.array(sizes(bad), float) - np.array(sizes(good), float)) / lengths


def _with_feature(docs: DataFrame, good: bytes, bad: bytes, whole: bool = False) -> DataFrame:
    """docs with the column feature, and without text unless they are taken whole."""
    keep = [c for c in docs.columns if whole or c != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + ", feature double"

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = pc.fill_null(part.column(part.num_columns - 1).cast(pa.large_binary()), b"").to_pylist()
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(_features(texts, good, bad))], [*keep, "feature"])

    # the text comes last, and once
    return docs.select(*(c for c in docs.columns if c != "text"), "text").mapInArrow(compress, schema)


def _dictionary(texts: list[str]) -> bytes:
    out = bytearray()
    for x in texts:
        if len(out) + len(b := x.encode() + b"\n") <= DICTIONARY_BYTES:
            out += b
    return bytes(out)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by damped Newton steps with a weak ridge; x in its own scale."""
    if len(x) == 0:
        return 0.0, 0.0
    scale = float(np.std(x)) or 1.0
    a = np.column_stack([x / scale, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2), a.T @ (y - p) - 1e-2 * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    ids = labels.where((fold("doc_id", SPLIT) != 0) & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    ids = ids.groupBy("doc_id").agg(F.max("quality").alias("quality"))  # a row twice, or with two labels: the higher
    chosen = {r.doc_id: r.quality for q in (0, 1) for r in hash_sample(ids.where(F.col("quality") == q), "doc_id", PER_CLASS).collect()}
    if not chosen:
        return Model(b"", b"", 0.0, 0.0)
    picked = docs.sparkSession.createDataFrame([(int(k), int(v)) for k, v in chosen.items()], "__id long, quality int")
    # about 2 * PER_CLASS rows, however often a doc_id is there: combined before the shuffle, written once
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("__id"))
    rows = stored(rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text")), "labelled-texts")
    order, found = F.xxhash64("doc_id"), {}
    there = {r.quality: r.n for r in rows.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    for q in (0, 1):
        short = rows.where((F.col("quality") == q) & (F.length("text").between(1, LONGEST)))
        most = min(IN_DICTIONARY, max(1, there.get(q, 0) // SHARE))
        found[q] = short.orderBy(order, "doc_id", "text").limit(most).collect()
    good, bad = (_dictionary([r.text for r in found[q]]) for q in (1, 0))
    used = {r.doc_id for q in (0, 1) for r in found[q]}
    rest = (rows.where(~F.col("doc_id").isin(*used)) if len(used) < len(chosen) else rows).drop("doc_id")
    seen = [(r.feature, r.quality) for r in _with_feature(rest, good, bad).collect()]
    x, y = np.array([f for f, _ in seen], float), np.array([q for _, q in seen], float)
    # each class is sampled up to the same bound: weigh the offset back to the labels' own shares
    shares = {r.quality: r["count"] for r in ids.groupBy("quality").count().collect()}
    if not good or not bad or len(set(y)) < 2:
        return Model(good, bad, 0.0, float(np.log((shares.get(1, 0) + 1) / (shares.get(0, 0) + 1))))
    slope, offset = _logistic(x, y)
    offset += float(np.log(shares[1] / shares[0]) - np.log(y.sum() / (len(y) - y.sum())))
    return Model(good, bad, slope, offset)


def apply(docs: DataFrame, model: Model, whole: bool = False) -> DataFrame:
    """docs with score and predicted, and without text unless they are taken whole."""
    out = _with_feature(docs, model.good, model.bad, whole)
    score = 1 / (1 + F.exp(-(F.col("feature") * model.slope + model.offset)))
    return out.withColumn("score", score).withColumn("predicted", (F.col("score") >= CUT).cast("int")).drop("feature")


def quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    out = apply(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", (fold("doc_id", SPLIT) == 0).alias("held_out"), "score", "predicted")
