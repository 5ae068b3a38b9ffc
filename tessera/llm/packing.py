"""Packing: order-preserving cuts by dynamic programming with a monotone queue.

The tokens of a partition's documents form one stream in the order of the rows. The stream is cut into
sequences of at most LENGTH tokens; cuts lie at the end of a document (free), of a sentence (SENTENCE), or,
inside long sentences, every STEP tokens (INSIDE). The cheapest set of cuts minimises padding plus these
penalties: best[i] = penalty[i] + LENGTH - at[i] + min(best[j] + at[j]) over the cuts j at most LENGTH back, a
sliding minimum that a monotone queue gives in constant time. What is left at the end of a run of about
CHUNK_BYTES of text is cut into powers of two where that is cheaper than padding.

No shuffle: each partition packs its own rows, in their order; its number is the upper part of sequence_id.

Cases: a null text counts as empty and yields the end token alone. Rows with the same doc_id are documents of
their own. Null doc_ids are passed through. An empty table gives no rows. Extra columns are ignored. A text
that holds the string of a special token is encoded by the tokenizer itself, others by the same vocabulary's
ranks; very long texts are encoded in parts that meet after a line break between two visible characters, where
the tokenizer splits in any case.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tessera.llm.common import CHUNK_BYTES, text_parts

LENGTH, END_ID = 2048, 1
#: Penalties in tokens of padding; distance of the cuts inside long sentences.
SENTENCE, INSIDE, STEP = 4, 24, 32
#: Characters of a part of a very long text.
PART = 1 << 20

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """The ids that the tokenizers library gives for a vocabulary file, by the ranks of the same vocabulary."""

    def __init__(self, vocabulary: str, ranks: bytes, pattern: str):
        import tiktoken

        self.vocabulary, self.whole = vocabulary, None
        pairs = (line.split() for line in ranks.splitlines())
        table = {base64.b64decode(a): int(b) for a, b in pairs}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.special = [t["content"] for t in json.loads(vocabulary).get("added_tokens", [])]
        #: Whether a token ends a sentence or a line, by id.
        self.ends = np.zeros(max([*table.values(), END_ID, *(t["id"] for t in json.loads(vocabulary).get("added_tokens", []))]) + 1, bool)
        self.ends[[i for b, i in table.items() if b.rstrip(b"\n ")[-1:] in (b".", b"!", b"?") or b"\n" in b]] = True

    def __call__(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_str(self.vocabulary)
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def parts(self, text: str) -> Iterator[list[int]]:
        if len(text) > PART and not any(s in text for s in self.special):
            yield from map(self, text_parts(text, PART))
        else:
            yield self(text)


def cut(at: list[int], penalty: list[int], length: int = LENGTH) -> list[int]:
    """The cheapest cuts among `at` (ascending, from 0, gaps at most `length`), both ends included.

    The rest behind the last of them may be cut further, into powers of two.
    """
    n, total = len(at) - 1, at[-1]
    best, back = [0] * (n + 1), [0] * (n + 1)
    queue, value, head = [0], [0], 0  # value: best + at, rising from head
    for i in range(1, n + 1):
        here = at[i]
        while at[queue[head]] < here - length:
            head += 1
        b = best[i] = value[head] + length - here + penalty[i]
        back[i] = queue[head]
        v = b + here
        while len(queue) > head and value[-1] >= v:
            queue.pop()
            value.pop()
        queue.append(i)
        value.append(v)
    # the last stretch: padded, or in powers of two
    ends = [(best[j] + min(length - total + at[j], INSIDE * ((total - at[j]).bit_count() - 1)), j) for j in range(n - 1, -1, -1) if total - at[j] <= length] if n else []
    if not ends:
        return at[:1]
    j, out = min(ends)[1], []
    rest, here = total - at[j], total
    if INSIDE * (rest.bit_count() - 1) < length - rest:  # cuts from the end: the smallest power last
        out.append(total)
        while rest & (rest - 1):
            here -= rest & -rest
            rest &= rest - 1
            out.append(here)
    else:
        out.append(total)
    while True:
        out.append(at[j])
        if j == 0:
            return out[::-1]
        j = back[j]


def _cuts(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray) -> np.ndarray:
    kind = np.where(ends[ids], SENTENCE, -1)
    kind[doc_ends - 1] = 0
    at = np.flatnonzero(kind >= 0) + 1
    penalty = kind[at - 1]
    before = np.concatenate([[0], at[:-1]])
    extra = (at - before - 1) // STEP
    where = np.repeat(before, extra) + STEP * (np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra) + 1)
    at, penalty = np.concatenate([[0], at, where]), np.concatenate([[0], penalty, np.full(len(where), INSIDE)])
    order = np.argsort(at, kind="stable")
    return np.array(cut(at[order].tolist(), penalty[order].tolist()), np.int64)


def _pack(ids: np.ndarray, doc_ends: np.ndarray, doc_ids: pa.Array, ends: np.ndarray, first: int) -> tuple[pa.RecordBatch, int]:
    starts = np.concatenate([[0], doc_ends[:-1]])
    cuts = _cuts(ids, doc_ends, ends)
    piece = np.unique(np.concatenate([starts, cuts[:-1]]))
    stop = np.append(piece[1:], len(ids))
    doc = np.searchsorted(starts, piece, "right") - 1
    sequence = np.searchsorted(cuts, piece, "right") - 1
    raw, crc = memoryview(ids.astype("<u4").tobytes()), zlib.crc32
    sums = [crc(raw[4 * a : 4 * b]) for a, b in zip(piece.tolist(), stop.tolist())]
    columns = [doc_ids.take(pa.array(doc)), *map(pa.array, (piece - starts[doc], stop - piece)), pa.array(sums, pa.int64()), *map(pa.array, ((doc_ends - starts)[doc], first + sequence, piece - cuts[sequence]))]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")]), first + len(cuts) - 1


def pack(docs: DataFrame, vocabulary_path: str, ranks_path: str, pattern: str) -> DataFrame:
    """One row per piece of a document: see SCHEMA. The two files hold the same vocabulary."""
    files = docs.sparkSession.sparkContext.broadcast((Path(vocabulary_path).read_text(), Path(ranks_path).read_bytes()))  # under 3 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(*files.value, pattern)
        sequence = TaskContext.get().partitionId() << 33
        ids: list[np.ndarray] = []
        doc_ends: list[int] = []
        doc_ids: list[pa.Array] = []
        size = total = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence, size, total
            out, sequence = _pack(np.concatenate(ids), np.array(doc_ends, np.int64), pa.concat_arrays(doc_ids), encode.ends, sequence)
            ids.clear(), doc_ends.clear(), doc_ids.clear()
            size = total = 0
            return out

        for batch in batches:
            texts, first = pc.fill_null(batch.column(1), "").to_pylist(), 0
            for k, text in enumerate(texts):
                for part in encode.parts(text):
                    ids.append(np.array(part, np.int64))
                    total += len(part)
                ids.append(np.array([END_ID], np.int64))
                total += 1
                doc_ends.append(total)
                size += len(text)
                if size >= CHUNK_BYTES:
                    doc_ids.append(batch.column(0).slice(first, k + 1 - first))
                    first = k + 1
                    yield flush()
            if first < len(texts):
                doc_ids.append(batch.column(0).slice(first))
        if doc_ends:
            yield flush()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
