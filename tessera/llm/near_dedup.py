"""MinHash near-dedup: ProbMinHash signatures, banding, exact verification, components.

A text's elements are its 5-word shingles (words: runs without ASCII white space, A-Z lower-cased; a text of
1 to 4 words is one shingle). Each element draws the arrival times of a Poisson process whose rate is its
weight; every arrival goes to a random register, which keeps the earliest, and an element stops as soon as its
time passes the latest register of its text. The share of equal registers estimates the probability Jaccard of
the weighted sets. All weights are 1, however often a text repeats a shingle: so it is the Jaccard similarity of
the sets, the one that is verified. BANDS groups of ROWS registers are the buckets in which candidates meet; a
candidate pair is linked if the Jaccard similarity of the two shingle sets is at least the threshold, computed
exactly on 64-bit hashes.

Texts with the same words are one node from the start. First the nodes of a bucket are compared with one leader,
the node that meets most others. The buckets that still hold several components are then compared in full, in
blocks of about BLOCK nodes, two of them in a task; a task returns a forest of the links between components,
never the pairs. So no two of a bucket's nodes end in different classes unless they were compared.

Cases: null texts count as empty; texts without words are copies of each other. Rows with the same doc_id are
nodes of their own unless their words are the same. A null doc_id gets a class like any other row; a class
of null doc_ids alone has a null class_id. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, hashes, mix, stored, text_chunks, words_of
from tessera.llm.components import components

WORDS, THRESHOLD = 5, 0.8
#: At similarity 0.8 a pair meets in some bucket with probability 1 - 5e-5, at 0.5 with 0.55.
BANDS, ROWS = 26, 5
#: Nodes in a block of a large bucket.
BLOCK = 512
#: Bytes of text whose shingles are drawn and sorted at once: a task holds some thirty times as much.
TEXT_BYTES = 1 << 20
GOLD = np.uint64(0x9E3779B97F4A7C15)


def _fold(h: np.ndarray, text: np.ndarray, texts: int, seed: int) -> np.ndarray:
    """An order-dependent 64-bit hash of each text's word hashes."""
    first = np.searchsorted(text, np.arange(texts))
    at = (np.arange(len(h)) - first[text]).astype(np.uint64)
    out = np.zeros(texts, np.uint64)
    full = np.bincount(text, minlength=texts) > 0
    if full.any():
        out[full] = np.add.reduceat(mix(h + mix(at + np.uint64(seed))), first[full])
    return mix(out + np.uint64(seed))


def shingle(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of the distinct shingles, by text and hash; and two hashes of each text's words."""
    texts = len(offsets) - 1
    word, distinct, text = words_of(LOWER[data], offsets)
    h = hashes(distinct)[word]
    keys = np.column_stack([_fold(h, text, texts, 1), _fold(h, text, texts, 2)])
    n_words = np.bincount(text, minlength=texts)
    first = np.concatenate([[0], np.cumsum(n_words)])[:-1]
    n = max(0, len(h) - WORDS + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(WORDS):
        rolled = mix(rolled + GOLD) + h[k : k + n]
    inside = np.flatnonzero(text[:n] == text[WORDS - 1 :]) if n else np.zeros(0, np.int64)
    owner, value = text[inside], mix(rolled[inside])
    short = np.flatnonzero((n_words > 0) & (n_words < WORDS))
    if len(short):  # all the words are one shingle
        owner, value = np.concatenate([owner, short]), np.concatenate([value, keys[short, 0]])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return owner[at], value[at], np.diff(np.append(at, len(owner))), keys


def signatures(owner: np.ndarray, value: np.ndarray, weight: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """texts x registers: the element of the earliest arrival; 0 in texts without elements."""
    earliest = np.full(texts * registers, np.inf)
    chosen = np.zeros(texts * registers, np.uint64)
    seed, time, base, rate, who = value, np.zeros(len(value)), owner * registers, weight, owner
    k = 0
    while len(seed):
        k += 1
        draw = mix(seed + np.uint64(k * int(GOLD) % (1 << 64)))
        time = time - np.log1p(-((draw >> np.uint64(11)).astype(np.float64)) * 2.0**-53) / rate
        slot = base + (mix(draw ^ GOLD) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(earliest, slot, time)
        won = time == earliest[slot]
        chosen[slot[won]] = seed[won]
        latest = earliest.reshape(texts, registers).max(1)
        on = np.flatnonzero(time < latest[who])
        seed, time, base, rate, who = seed[on], time[on], base[on], rate[on], who[on]
    return chosen.reshape(texts, registers)


def _bands(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(sig), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(sig), b, np.uint64)
        for r in range(rows):
            h = mix(h + GOLD) + sig[:, b * rows + r]
        out[:, b] = mix(h)
    return out


def _binary(keys: np.ndarray) -> pa.Array:
    n = len(keys)
    data = np.ascontiguousarray(keys.astype(">u8"))
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, 16 * n + 1, 16, dtype=np.int32)), pa.py_buffer(data)])


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, n, data, offsets in text_chunks(batch.column(2), TEXT_BYTES):
            owner, value, _, keys = shingle(data, offsets)
            sig = signatures(owner, value, np.ones(len(value)), n, BANDS * ROWS)
            full = np.bincount(owner, minlength=n) > 0
            bands = _bands(sig[full], BANDS, ROWS).ravel()
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, n) for i in (0, 1)), _binary(keys), _lists(bands, full * BANDS)], ["doc_id", "text_hash", "key", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, n, data, offsets in text_chunks(batch.column(0), TEXT_BYTES):
            owner, value, _, keys = shingle(data, offsets)
            yield pa.RecordBatch.from_arrays([_binary(keys), _lists(value, np.bincount(owner, minlength=n))], ["key", "shingles"])


def _leaders(members: DataFrame) -> DataFrame:
    """(bucket, leader): the heaviest node of each bucket."""
    best = F.max(F.struct("weight", F.xxhash64("key").alias("o"), "key")).alias("l")
    return members.groupBy("bucket").agg(best).select("bucket", F.col("l.key").alias("leader"))


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of the sets in a with those in b."""
    flat = np.concatenate([*a, *b])
    _, number, times = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.cumsum(times > 1) - 1  # a shingle in one set only is in no intersection
    kept = (times > 1)[number]
    column = rank[number]
    row = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])[kept]
    column = column[kept]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        i, j = np.searchsorted(column, [at, at + 4096])
        has = np.zeros((len(a) + len(b), 4096), np.float32)
        has[row[i:j], column[i:j] - at] = 1
        out += has[: len(a)] @ has[len(a) :].T
    return out


def _compared(threshold: float):
    """Links between the components that meet in a bucket: a forest of them, for two blocks of it at a time."""

    def bucket(df: pd.DataFrame) -> list[tuple[bytes, bytes]]:
        own, other = df[df["block"] == df["lo"]], df[df["block"] == df["hi"]]
        a, b = own["shingles"].tolist(), other["shingles"].tolist()
        if not a or not b:
            return []
        common = _common(a, b)
        sizes = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])
        roots, number = np.unique(np.concatenate([own["root"].to_numpy(), other["root"].to_numpy()]), return_inverse=True)
        ra, rb = number[: len(a)], number[len(a) :]
        i, j = np.nonzero((common >= threshold * (sizes - common) - 1e-9) & (ra[:, None] != rb))
        ka, kb = own["key"].tolist(), other["key"].tolist()
        up, out = list(range(len(roots))), []

        def find(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for x, y in zip(i.tolist(), j.tolist()):
            fx, fy = find(ra[x]), find(rb[y])
            if fx != fy:
                up[fx] = fy
                out.append((min(ka[x], kb[y]), max(ka[x], kb[y])))
        return out

    def run(df: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([e for _, part in df.groupby("bucket", sort=False) for e in bucket(part)], columns=["a", "b"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    side = lambda c: sets.select(F.col("key").alias(c), F.col("shingles").alias(f"s{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(common >= threshold * (F.size("sa") + F.size("sb") - common) - 1e-9).select("a", "b")


def near_dedup(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_hash, class_id (the smallest doc_id of its class) and n_copies (rows of the class) of every row.

    text_hash is Spark's xxhash64 of the text: with doc_id it names the row.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    rows = stored(docs.mapInArrow(_sketch, "doc_id long, text_hash long, key binary, bands array<long>"), "sketches")
    nodes = rows.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.any_value("bands").alias("bands"), F.count(F.lit(1)).alias("n"))
    nodes = stored(nodes, "nodes")
    members = nodes.select("key", F.explode("bands").alias("bucket"))
    full = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stored(members.join(full, "bucket"), "members")
    # a node's weight is how often it meets others: the text that copies were made from comes before them
    weights = members.groupBy("key").agg(F.sum("n").alias("weight"))
    # the shingles of the nodes that met another one: their texts are read again
    met = weights.select("key").join(nodes.select("key", "doc_id"), "key")
    texts = docs.join(met.select(F.col("doc_id").alias("__doc")).distinct(), F.col("doc_id").eqNullSafe(F.col("__doc")), "left_semi")
    sets = texts.select("text").mapInArrow(_sets, "key binary, shingles array<long>")
    sets = stored(sets.join(weights.select("key"), "key", "left_semi").dropDuplicates(["key"]), "shingles")
    members = stored(members.select("bucket", "key").join(weights, "key"), "members")
    # first: every node of a bucket with its leader
    leaders = stored(_leaders(members), "leaders")
    pairs = members.join(leaders, "bucket").where("key <> leader").select(F.least("key", "leader").alias("a"), F.greatest("key", "leader").alias("b"))
    links = stored(_verified(stored(pairs.distinct(), "pairs"), sets, threshold), "links")
    roots = components(links).withColumnRenamed("id", "key")
    # then: the other nodes of the buckets in which more than one component is left
    rest = members.join(leaders, "bucket").where("key <> leader").select("bucket", "key")
    rest = stored(rest.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")), "rest")
    live = rest.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high")
    live = stored(live.select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "live")
    if not live.isEmpty():
        rest = rest.join(live, "bucket").join(sets, "key").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
        rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rest = rest.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
        # small buckets share a group, some fifty of them: enough for one call, few enough to spread
        groups = max(1, live.where("blocks = 1").count() // 50)
        small = F.when(F.col("blocks") == 1, F.pmod(F.col("bucket"), F.lit(groups))).otherwise(F.col("bucket"))
        more = rest.groupBy(small.alias("group"), (F.col("blocks") == 1).alias("is_small"), "lo", "hi").applyInPandas(_compared(threshold), "a binary, b binary")
        more = stored(more.distinct(), "links")
        roots = components(links.unionByName(more)).withColumnRenamed("id", "key")
    known = nodes.select("key", "doc_id", "n").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    known = stored(known, "roots")
    classes = known.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.sum("n").alias("n_copies"))
    return rows.select("doc_id", "text_hash", "key").join(known.select("key", "root").join(classes, "root"), "key").select("doc_id", "text_hash", "class_id", "n_copies")


#: The same in DuckDB's SQL, for small tables: all pairs that share a shingle, and reachability. Meant for tests.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words
), sizes AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1
), common AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS MATERIALIZED (
  SELECT x, y FROM common JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE c >= 0.8e0 * (a.n + b.n - c) - 1e-9
  UNION SELECT a.doc_id, b.doc_id FROM words a JOIN words b ON a.w = b.w AND a.doc_id < b.doc_id
), ways AS MATERIALIZED (
  SELECT x, y FROM links UNION SELECT y, x FROM links
), reach AS (
  SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, ways.y FROM reach JOIN ways ON ways.x = reach.r
), classes AS (
  SELECT doc_id, min(r) AS class_id FROM reach GROUP BY 1
)
SELECT doc_id, class_id, CAST(count(*) OVER (PARTITION BY class_id) AS BIGINT) AS n_copies, doc_id = class_id AS kept FROM classes
"""
