"""Byte-level BPE: a segment tree over byte positions holds the leftmost pair of lowest rank.

A text is split by a pattern; each piece that isn't a token as a whole starts as its bytes. A leaf of the tree
is the rank of the pair that starts at a byte position, with that position, so the root is the leftmost pair of
the lowest rank. A merge relinks the live neighbours and updates three leaves, each in a logarithmic number of
steps. Pieces of up to WIDEST bytes are merged in lockstep, many trees side by side in one array; longer ones
have a tree of their own. Pieces already seen in the task are looked up in a bounded table.

Cases: a null text counts as empty and has no ids. Rows with the same doc_id are encoded one by one, null
doc_ids are passed through, extra columns are ignored. A long text is taken in parts that meet after a line break
between two visible characters, where the pattern splits in any case. Every byte has a token, so every text can be encoded
and decodes to itself.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tessera.llm.common import text_parts

#: Bytes of the pieces that are merged in lockstep; pieces kept in a task's table; characters taken at once, and of a part of a long text.
WIDEST, KEPT, AT_ONCE, PART = 64, 200_000, 1 << 20, 1 << 20
NONE = np.int64(1) << 40

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Bpe:
    def __init__(self, ranks: bytes, pattern: str):
        import regex

        # \s as Unicode's White_Space, whichever the regex library's own is
        space = r"\t-\r \x85\xa0  -     　"
        pattern = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{space}\p{{L}}\p{{N}}]").replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]")
        self.split = regex.compile(pattern).findall
        self.rank = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines())}
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        size = max(self.rank.values()) + 1
        words = [b""] * size
        for w, r in self.rank.items():
            words[r] = w
        self.length = np.array([len(w) for w in words], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self.bytes = np.frombuffer(b"".join(words), np.uint8)
        found = {}
        for w, r in self.rank.items():
            for k in range(1, len(w)):
                a, b = self.rank.get(w[:k]), self.rank.get(w[k:])
                if a is not None and b is not None:
                    found[a << 20 | b] = r
        self.pairs = found
        # open addressing: half empty, so a search ends soon
        self.bits = max(4, (2 * len(found)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE)
        for key, r in found.items():
            at = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> (64 - self.bits)
            while self.keys[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.keys[at], self.values[at] = key, r
        self.seen: dict[str, bytes] = {}

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of ids, NONE where there is none."""
        key = left << 20 | right
        at = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.full(len(key), NONE)
        todo = np.arange(len(key))
        while len(todo):
            there = self.keys[at]
            hit = there == key
            out[todo[hit]] = self.values[at[hit]]
            on = ~hit & (there >= 0)
            todo, key, at = todo[on], key[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def merge_all(self, pieces: list[bytes], width: int) -> list[bytes]:
        """The ids of pieces of at most `width` bytes (a power of two), as little-endian 32-bit integers."""
        n = len(pieces)
        lengths = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        # columns beyond the text and a last one stand for "no neighbour"
        ids = np.zeros((n, width + 1), np.int64)
        ids[:, :width] = self.single[raw]
        live = np.arange(width) < lengths[:, None]
        after = np.where(np.arange(1, width + 1) < lengths[:, None], np.arange(1, width + 1), width)
        after = np.concatenate([after, np.full((n, 1), width)], 1)
        before = np.tile(np.arange(-1, width), (n, 1))  # -1: none
        tree = np.full((n, 2 * width), NONE * width)
        row, col = np.nonzero(np.arange(1, width + 1) < lengths[:, None])
        tree[row, width + col] = self._lookup(ids[row, col], ids[row, col + 1]) * width + col
        for k in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
        rows = np.flatnonzero(tree[:, 1] < NONE * width)
        while len(rows):
            at = tree[rows, 1] % width
            gone = after[rows, at]
            then = after[rows, gone]
            ids[rows, at] = tree[rows, 1] // width
            live[rows, gone] = False
            after[rows, at] = then
            before[rows, then] = at
            self._put(tree, rows, gone, np.full(len(rows), NONE * width), width)
            has = then < width
            value = np.full(len(rows), NONE * width)
            value[has] = self._lookup(ids[rows[has], at[has]], ids[rows[has], then[has]]) * width + at[has]
            self._put(tree, rows, at, value, width)
            prior = before[rows, at]
            has = prior >= 0
            r, p = rows[has], prior[has]
            self._put(tree, r, p, self._lookup(ids[r, p], ids[r, at[has]]) * width + p, width)
            rows = rows[tree[rows, 1] < NONE * width]
        flat = ids[:, :width][live].astype("<u4").tobytes()
        ends = np.cumsum(live.sum(1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    @staticmethod
    def _put(tree: np.ndarray, rows: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> None:
        """Sets one leaf of each of the rows, and the nodes above it."""
        node = at + width
        tree[rows, node] = value
        while width > 1:
            node >>= 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            width >>= 1

    def merge_one(self, piece: bytes) -> bytes:
        """The ids of one piece of any length; in plain Python, as one tree gains nothing from arrays."""
        n = len(piece)
        width = 1 << max(1, (n - 1).bit_length())
        none, get = int(NONE) * width, self.pairs.get
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]

        def leaf(i: int) -> int:
            j = after[i]
            r = get(ids[i] << 20 | ids[j]) if j >= 0 else None
            return none if r is None else r * width + i

        tree = [none] * width + [leaf(i) for i in range(n)] + [none] * (width - n)
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(i: int, value: int) -> None:
            k = i + width
            tree[k] = value
            while k > 1:
                k >>= 1
                least = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == least:
                    break
                tree[k] = least

        while tree[1] < none:
            rank, i = divmod(tree[1], width)
            gone = after[i]
            ids[i], after[i] = rank, after[gone]
            if after[gone] >= 0:
                before[after[gone]] = i
            put(gone, none)
            put(i, leaf(i))
            if before[i] >= 0:
                put(before[i], leaf(before[i]))
        out, i = [], 0
        while i >= 0:
            out.append(ids[i])
            i = after[i]
        return np.array(out, "<u4").tobytes()

    def learn(self, pieces: set[str]) -> None:
        """Puts the ids of pieces that aren't there yet in the table."""
        if len(self.seen) > KEPT:
            self.seen.clear()
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces - self.seen.keys():
            b = p.encode()
            r = self.rank.get(b)
            if r is not None:
                self.seen[p] = r.to_bytes(4, "little")
            elif len(b) > WIDEST:
                self.seen[p] = self.merge_one(b)
            else:
                by_width.setdefault(1 << (len(b) - 1).bit_length(), []).append((p, b))
        for width, group in by_width.items():
            for k in range(0, len(group), 1 << 14):
                part = group[k : k + (1 << 14)]
                self.seen.update(zip((p for p, _ in part), self.merge_all([b for _, b in part], width)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        split = [self.split(t) for t in texts]
        self.learn(set(chain.from_iterable(split)))
        seen = self.seen.__getitem__
        return [b"".join(map(seen, p)) for p in split]

    def digests(self, text: str) -> tuple[int, str, str]:
        """The number of a text's ids, and the digests of the ids and of the bytes that they decode to; the text is taken in parts."""
        n, coded, decoded = 0, hashlib.sha256(), hashlib.sha256()
        for part in text_parts(text, PART):
            (ids,) = self.encode([part])
            n += len(ids) // 4
            coded.update(ids)
            decoded.update(self.decode([ids])[0])
        return n, coded.hexdigest(), decoded.hexdigest()

    def decode(self, ids: list[bytes]) -> list[bytes]:
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
        lengths = self.length[flat]
        ends = np.cumsum(lengths)
        where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[flat] - (ends - lengths), lengths)
        out = self.bytes[where].tobytes()
        at = np.concatenate([[0], ends])[np.cumsum([0, *(len(x) // 4 for x in ids)])].tolist()
        return [out[a:b] for a, b in zip(at, at[1:])]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per row: its number of ids, and digests of the ids and of the bytes that they decode to."""
    ranks = docs.sparkSession.sparkContext.broadcast(Path(ranks_path).read_bytes())  # under 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(ranks.value, pattern)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "").to_pylist()
            at = 0
            while at < len(texts):
                end = size = at
                size = 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= AT_ONCE):
                    size += len(texts[end])
                    end += 1
                if size > PART:  # a long text among them: each in parts, so that no more than one is held as ids
                    found = [bpe.digests(t) for t in texts[at:end]]
                else:
                    ids = bpe.encode(texts[at:end])
                    found = [(len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(y).hexdigest()) for x, y in zip(ids, bpe.decode(ids))]
                columns = [batch.column(0).slice(at, end - at), *(pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.string(), pa.string())))]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])
                at = end

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
