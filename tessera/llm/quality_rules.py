"""Quality rules: counts of a text, and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed word 1-grams and 2-grams are counted: one over the whole raw corpus, one over
trusted texts. A text's verdict is the mean over its n-grams of log(p_trusted / p_raw), against a fixed
threshold. Words of the junk that the trusted texts lack pull the mean down; texts like the trusted ones
lie near 0 or above.

Cases: a null or empty text has no words, fails the base rule and is not kept; its ratio is 0. Rows with the
same doc_id are judged one by one. Null doc_ids are passed through. Without any trusted row both multinomials
are the raw one, all ratios are 0 and the base rule alone decides. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, hashes, mix, pieces, spans, text_chunks, words_of

#: log2 of the buckets of an n-gram's hash; the model is two floats a bucket, whatever the corpus.
BUCKET_BITS = 16
#: Trusted ids, 8 bytes each, up to which they go to every task; more of them are joined to the texts. Either way all are counted.
TRUSTED_SENT = 8_000_000
#: Bytes of text that are taken at once: what a task holds is a small multiple of it.
TEXT_BYTES = 1 << 20
#: Texts whose mean log ratio is below this are rejected.
THRESHOLD = -0.1
#: Pseudo-count of a bucket in the target, where the raw corpus is scaled to the target's size: an n-gram that
#: is rare in both says nothing.
ALPHA = 16.0
#: The characters that n_symbols counts; fixed by the contract.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

RULES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, log_ratio double, kept boolean"


@dataclass(frozen=True)
class Model:
    log_ratio: np.ndarray
    threshold: float


def _grams(word: np.ndarray, hashed: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of the 1-grams and 2-grams."""
    h = hashed[word]
    same = text[1:] == text[:-1]
    pairs = mix(h[:-1] * np.uint64(3) + h[1:])[same] if len(h) else h
    shift = np.uint64(64 - BUCKET_BITS)
    return np.concatenate([h >> shift, pairs >> shift]).astype(np.int64), np.concatenate([text, text[1:][same]])


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(doc_id): all that are labelled good and not toxic."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null")
    return good.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def fit(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sent: int = TRUSTED_SENT) -> Model:
    """Counts every n-gram of every text; those of all trusted rows also for the target."""
    size, good = 1 << BUCKET_BITS, trusted_ids(labels)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if good.count() <= sent:  # the texts stay where they are
        ids = docs.sparkSession.sparkContext.broadcast(np.sort(good.toArrow().column(0).to_numpy()))
    else:
        ids, good = None, good.withColumn("__trusted", F.lit(True))
        docs = docs.join(good, "doc_id", "left").select("doc_id", "text", F.coalesce("__trusted", F.lit(False)).alias("trusted"))

    def marked(batch: pa.RecordBatch) -> np.ndarray:
        if ids is None:
            return batch.column(2).to_numpy(zero_copy_only=False)
        own, known = batch.column(0), ids.value
        if not len(known):
            return np.zeros(len(own), bool)
        values = pc.fill_null(own, 0).to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(known, values), len(known) - 1)
        return (known[at] == values) & own.is_valid().to_numpy(zero_copy_only=False)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            is_target = marked(batch)
            for at, n, data, offsets in text_chunks(batch.column(1), TEXT_BYTES):
                word, distinct, text = words_of(data, offsets)
                bucket, text = _grams(word, hashes(distinct), text)
                raw += np.bincount(bucket, minlength=size)
                target += np.bincount(bucket[is_target[at : at + n][text]], minlength=size)
        found = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (found, raw[found], target[found])], ["bucket", "raw", "target"])

    counts = docs.mapInArrow(count, "bucket long, raw long, target long")
    rows = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.zeros(size), np.zeros(size)
    for r in rows:  # 65,536 rows at most, whatever the corpus
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    if not target.sum():
        target = raw
    expected = raw * (target.sum() / max(1.0, raw.sum()))
    return Model(np.log((target + ALPHA) / (expected + ALPHA)), threshold)


def _repeated(word: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """For each text, its words inside a 3-word window that the text has twice or more."""
    n = len(word)
    if n < 3:
        return np.zeros(texts, np.int64)
    size = int(word.max()) + 1
    pair = word[:-1] * size + word[1:]
    _, pair = np.unique(pair, return_inverse=True)
    window = pair[:-1] * size + word[2:]  # below words * distinct words: no overflow under 3e9 words
    at = np.flatnonzero(text[2:] == text[:-2])
    order = at[np.lexsort((window[at], text[at]))]
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = (window[order[1:]] == window[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    twice = order[same[1:] | same[:-1]]
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[twice + k] = True
    return np.bincount(text[hit], minlength=texts)


def _repeated_lines(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, texts: int) -> np.ndarray:
    """For each text, its lines with a word that equal an earlier line of it."""
    starts, ends, text = spans(data != 0x0A, offsets)  # empty lines have no word
    if not len(starts):
        return np.zeros(texts, np.int64)
    line = pc.dictionary_encode(pieces(data, data != 0x0A, starts, ends)).indices.to_numpy(zero_copy_only=False).astype(np.int64)
    before = np.concatenate([[0], np.cumsum(inside)])
    full = np.flatnonzero(before[ends] > before[starts])
    order = full[np.lexsort((full, line[full], text[full]))]
    again = order[1:][(line[order[1:]] == line[order[:-1]]) & (text[order[1:]] == text[order[:-1]])]
    return np.bincount(text[again], minlength=texts)


def _judge(data: np.ndarray, offsets: np.ndarray, texts: int, model: Model) -> list[np.ndarray]:
    inside = ~SPACE[data]
    word, distinct, text = words_of(data, offsets)
    per_text = lambda mask: np.add.reduceat(np.append(mask, 0), offsets[:-1], dtype=np.int64) * (np.diff(offsets) > 0)
    n_words = np.bincount(text, minlength=texts)
    word_chars = per_text(inside & ((data & 0xC0) != 0x80))
    n_symbols = per_text(SYMBOLS[data])
    repeats = _repeated(word, text, texts)
    bucket, gram_text = _grams(word, hashes(distinct), text)
    ratio = np.bincount(gram_text, model.log_ratio[bucket], texts) / np.maximum(1, np.bincount(gram_text, minlength=texts))
    failed = (n_words < 50) | (100 * repeats > 50 * n_words)
    return [n_words, word_chars, n_symbols, _repeated_lines(data, offsets, inside, texts), repeats, failed, ratio, ~failed & (ratio >= model.threshold)]


def apply(docs: DataFrame, model: Model, keep: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """The columns `keep` of every row, with the counts, the mean log ratio and the verdict."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + ", " + RULES
    names = [*keep, *(x.split()[0] for x in RULES.split(", "))]
    rows = docs.select(*keep) if "text" in keep else docs.select(*keep, F.col("text").alias("__text"))  # a text goes to Python once
    place = rows.columns.index("text" if "text" in keep else "__text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n, data, offsets in text_chunks(batch.column(place), TEXT_BYTES):
                columns = [batch.column(i).slice(at, n) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, _judge(data, offsets, n, model))], names)

    return rows.mapInArrow(judge, schema)


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the counts, log_ratio and kept of every document."""
    return apply(docs, fit(docs, labels, threshold))
