"""What the text operators share: tables, shared scratch tables, and numpy views of Arrow text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import stored  # noqa: F401  for the operators

#: The six ASCII white-space bytes that end a word: space and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text that the numpy operators take at once; a longer text is taken whole.
CHUNK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str, n: int) -> Column:
    """crc32 of doc_id written as text, mod n; a null doc_id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def hash_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """All rows if there are at most `most`; else those whose key's hash is below a threshold that leaves about as many.

    The expected number is `most`; unlike an ordered limit it sends nothing else to the driver, whatever the tasks.
    """
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 30)) < int((1 << 30) * most / n))


def text_chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) of runs of whole texts; a null text is empty.

    offsets has rows + 1 entries from 0. A run holds at most `most` bytes, or one longer text.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, end - at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


#: Between a line break after a visible character and another visible character the tokenizers' patterns split in any case.
_SAFE = re.compile(r"(?<=\S\n)(?=\S)")


def text_parts(text: str, most: int) -> Iterator[str]:
    """The text in parts of at least `most` characters that meet where a tokenizer splits; whole if there is no such place."""
    at = 0
    while len(text) - at > most and (found := _SAFE.search(text, at + most)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text) of the maximal runs of true bytes, cut where texts meet."""
    n = len(inside)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    cuts = offsets[:-1][offsets[:-1] < n]
    left = np.empty(n, bool)
    left[0] = True
    np.logical_not(inside[:-1], out=left[1:])
    left[cuts] = True
    right = np.empty(n, bool)
    right[-1] = True
    np.logical_not(inside[1:], out=right[:-1])
    right[cuts[cuts > 0] - 1] = True
    starts = np.flatnonzero(inside & left)
    ends = np.flatnonzero(inside & right) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def pieces(data: np.ndarray, inside: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as an Arrow array; `inside` marks their bytes."""
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    kept = np.ascontiguousarray(data[inside])
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(number of each word, the distinct words, text of each word) of a run of texts."""
    inside = ~SPACE[data]
    starts, ends, text = spans(inside, offsets)
    coded = pc.dictionary_encode(pieces(data, inside, starts, ends))
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, text


_POWERS = np.zeros(0, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(max(n, 1024), 0x9E3779B97F4A7C15, np.uint64)
        steps[0] = 1
        _POWERS = np.multiply.accumulate(steps)
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each entry, the same on every machine: a polynomial of its bytes and its length, scrambled."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    _, where, data = words.buffers()
    offsets = np.frombuffer(where, np.int64)[words.offset : words.offset + n + 1]
    lengths = np.diff(offsets)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    at = np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], lengths)
    values = (data.astype(np.uint64) + np.uint64(1)) * _powers(int(lengths.max(initial=1)))[at]
    out = np.zeros(n, np.uint64)
    full = lengths > 0
    if full.any():
        out[full] = np.add.reduceat(values, (offsets[:-1] - offsets[0])[full])
    return mix(out ^ (lengths.astype(np.uint64) << np.uint64(40)))
