"""Embedding near-dedup: product quantisation over inverted lists, exact cosine rerank, components.

Vectors are scaled to length 1, where cosine c is the distance sqrt(2 - 2c). Coarse centroids and the codebooks
of SUBSPACES parts of the residuals are fitted by k-means on a bounded sample; every vector is then put in the
list of its label and nearest centroid, with its residual's codes and the exact length of what the codes miss:
an entry of the list, coded once. There are as many centroids as leave about BLOCK entries in the lists of the
largest label.

Probing is sufficient, not approximate: a vector within distance r of a query lies in another list only if the
plane between the two centroids is within r of the query, so just those lists are probed, and of two lists only
the one with the larger number by vectors of the smaller one, since links go both ways. In a list the distance
to a code, read from tables, differs from the true one by at most the length that the code misses; entries
beyond r plus that are skipped, the others are compared exactly. So no link is lost to the index.

Lists and the queries to them are split into blocks of about BLOCK vectors; a task compares one block with one
other, or with itself. It returns a count of links per vector and a spanning forest of them, never the pairs.
Vectors travel in the bytes that they came in. Equal vectors with the same label are one node from the start,
with their number.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and vectors with a null label,
link with nothing; so do vectors of different lengths. Rows with the same vec_id are vectors of their own. Null
vec_ids get counts, and a null component_id if no other row of the component has an id. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import hash_sample, stored
from tessera.llm.components import components
from tessera.sources.shared import steady

COSINE = 0.98
#: Vectors that the index is fitted on, about, if there are more, chosen by hash; k-means rounds; parts of a residual; codes of a part.
SAMPLE, ROUNDS, SUBSPACES, CODES = 20_000, 8, 8, 64
#: Vectors in a block, and in a list on average; most centroids.
BLOCK, CELLS = 8192, 4096
SLACK = 1e-6


@dataclass(frozen=True)
class Index:
    centroids: np.ndarray  # cells x dimension
    books: list[np.ndarray]  # per part: codes x its dimensions
    parts: list[np.ndarray]  # per part: its dimensions
    kind: str  # of the numbers that vectors come in


def units(vectors, kind: str) -> np.ndarray:
    """The vectors (bytes of numbers of that kind) in double precision, scaled to length 1."""
    x = np.frombuffer(b"".join(vectors), kind).astype(np.float64).reshape(len(vectors), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the square
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        near = _nearest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(c))
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([np.argmax(x[k : k + 4096] @ c.T - half, 1) for k in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def fit(sample: np.ndarray, cells: int, kind: str) -> Index:
    """The index with so many centroids, from a sample of unit vectors."""
    dimension = sample.shape[1]
    centroids = _kmeans(sample, cells, 1)
    residual = sample - centroids[_nearest(sample, centroids)]
    parts = [p for p in np.array_split(np.arange(dimension), SUBSPACES) if len(p)]
    return Index(centroids, [_kmeans(residual[:, p], CODES, 2 + k) for k, p in enumerate(parts)], parts, kind)


def _clean(kind: str):
    """(vec_id, label, key, vec): key and vec (the components' bytes) are null where the vector can't link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            labels = batch.column(1).to_pylist()
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.list_flatten(lists)  # of lists that aren't null, in order
            x = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).astype(kind) + np.array(0, kind)  # no -0.0
            ends = np.cumsum(sizes)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            some = np.concatenate([[0], np.cumsum(x != 0)])
            links = (sizes > 0) & (bad[ends] == bad[ends - sizes]) & (some[ends] > some[ends - sizes])
            raw, width = x.tobytes(), x.dtype.itemsize
            vecs = [raw[width * (e - n) : width * e] if ok and label is not None else None for ok, label, e, n in zip(links.tolist(), labels, ends.tolist(), sizes.tolist())]
            keys = [None if v is None else hashlib.md5(label.encode() + b"," + v).digest() for label, v in zip(labels, vecs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())], ["vec_id", "label", "key", "vec"])

    return run


PLACED = "label string, cell int, home int, key binary, n long, vec binary, codes binary, missed double"


def _place(index: Index, radius: float):
    """Rows of both kinds: the list entry of each node (cell = home) with its codes, and a probe for each list it must search."""
    c = index.centroids
    gap = np.sqrt(np.maximum(((c[:, None] - c[None]) ** 2).sum(-1) if len(c) <= 512 else (c * c).sum(1)[:, None] + (c * c).sum(1) - 2 * c @ c.T, 1e-300))
    names = [f.split()[0] for f in PLACED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = units(part.column(3).to_pylist(), index.kind)
                score = x @ c.T - (c * c).sum(1) / 2
                home = score.argmax(1)
                residual = x - c[home]
                codes = np.stack([_nearest(residual[:, p], b) for p, b in zip(index.parts, index.books)], 1).astype(np.uint8)
                missed = np.sqrt(sum(((residual[:, p] - b[q]) ** 2).sum(1) for p, b, q in zip(index.parts, index.books, codes.T)))
                # distance from x to the plane between its centroid and another
                plane = (score[np.arange(len(x)), home][:, None] - score) / gap[home]
                row, cell = np.nonzero((plane <= radius + SLACK) & (np.arange(len(c)) > home[:, None]))
                coded = pa.array([r.tobytes() for r in codes] + [None] * len(row), pa.binary())
                missed = pa.array(np.append(missed, np.zeros(len(row))))
                row, cell = np.concatenate([np.arange(len(x)), row]), np.concatenate([home, cell])
                label, key, n, vec = (part.column(k).take(pa.array(row)) for k in range(4))
                yield pa.RecordBatch.from_arrays([label, pa.array(cell.astype(np.int32)), pa.array(home[row].astype(np.int32)), key, n, vec, coded, missed], names)

    return run


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> list[int]:
    """The positions of the links that join two components."""
    up = list(range(n))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    out = []
    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist())):
        i, j = find(i), find(j)
        if i != j:
            up[i] = j
            out.append(k)
    return out


def _compare(index: Index, cosine: float, radius: float):
    """Links between a block of a list's entries and a block of queries to them, or among the entries of a block."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"a": [], "b": [], "n": []}).astype({"n": "int64"})
        entries, queries = df[~df["is_query"]], df[df["is_query"]]
        within = df["l"].iloc[0] == df["q"].iloc[0] and not df["foreign"].iloc[0]
        if within:
            queries = entries
        if not len(entries) or not len(queries):
            return empty
        y = units(entries["vec"].tolist(), index.kind)
        x = y if within else units(queries["vec"].tolist(), index.kind)
        cell = int(entries["cell"].iloc[0])
        codes = np.frombuffer(b"".join(entries["codes"]), np.uint8).reshape(len(y), -1).T
        reach = (radius + entries["missed"].to_numpy() + SLACK) ** 2
        yk, xk = entries["key"].to_numpy(), queries["key"].to_numpy()
        keys, number = np.unique(np.concatenate([yk, xk]), return_inverse=True)
        yi, xi = number[: len(yk)], number[len(yk) :]
        yn, xn = entries["n"].to_numpy(), queries["n"].to_numpy()
        links, found_a, found_b = np.zeros(len(keys), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(x), 128):
            q = x[at : at + 128] - index.centroids[cell]
            distance = np.zeros((len(q), len(y)))
            for p, b, code in zip(index.parts, index.books, codes):
                tables = ((q[:, p][:, None] - b[None]) ** 2).sum(-1)
                distance += tables[:, code]
            i, j = np.nonzero(distance <= reach)
            if within:  # both ways round: one of them counts
                i, j = i[xi[i + at] < yi[j]], j[xi[i + at] < yi[j]]
            for k in range(0, len(i), 1 << 16):
                ii, jj = i[k : k + (1 << 16)] + at, j[k : k + (1 << 16)]
                hit = np.einsum("ij,ij->i", x[ii], y[jj]) >= cosine
                ii, jj = ii[hit], jj[hit]
                np.add.at(links, xi[ii], yn[jj])
                np.add.at(links, yi[jj], xn[ii])
                kept = _forest(xi[ii], yi[jj], len(keys))
                found_a.append(xi[ii][kept])
                found_b.append(yi[jj][kept])
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        kept = _forest(a, b, len(keys))
        a, b, some = a[kept], b[kept], np.flatnonzero(links)
        return pd.concat([empty, pd.DataFrame({"a": keys[a], "b": keys[b], "n": 0}), pd.DataFrame({"a": keys[some], "b": None, "n": links[some]})])

    return run


def embedding_dedup(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links and component_id of every row."""
    radius = math.sqrt(2 - 2 * cosine)
    steady(embeddings.sparkSession)  # else the blocks of a list stay together, as the list was dealt
    kind = "<f4" if embeddings.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    values = "embedding" if kind == "<f4" else F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), values)
    rows = stored(rows.mapInArrow(_clean(kind), "vec_id long, label string, key binary, vec binary"), "vectors")
    nodes = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("vec_id"), F.any_value("label").alias("label"), F.any_value("vec").alias("vec"), F.count(F.lit(1)).alias("n"))
    nodes = stored(nodes, "vector-nodes")
    places = None
    size = F.octet_length("vec").alias("d")
    largest = nodes.groupBy(size, "label").agg(F.count(F.lit(1)).alias("n")).groupBy("d").agg(F.max("n").alias("n"))
    for r in largest.orderBy("d").collect():  # the lengths of the vectors: one, as a rule
        sized = nodes.where(F.octet_length("vec") == r.d)
        sample = [s.vec for s in hash_sample(sized, "key", SAMPLE).select("key", "vec").orderBy("key").collect()]
        index = fit(units(sample, kind), max(1, min(CELLS, r.n // BLOCK)), kind)
        found = _links(sized, index, cosine, radius)
        places = found if places is None else places.unionByName(found)
    if places is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    links = stored(places, "vector-links")
    counts = links.groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("linked"))
    roots = components(links.where("b is not null")).withColumnRenamed("id", "key")
    known = nodes.select("key", "vec_id", "n").join(counts, "key", "left").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    known = stored(known, "vector-roots")
    least = known.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    known = known.join(least, "root").select("key", "component_id", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    known = stored(known, "vector-classes")
    out = rows.select("vec_id", "key").join(known, "key", "left")
    own = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"))


def _links(nodes: DataFrame, index: Index, cosine: float, radius: float) -> DataFrame:
    """(a, null, links of a) and (a, b, 0) for the links of a spanning forest of each pair of blocks."""
    places = nodes.select("label", "key", "n", "vec").mapInArrow(_place(index, radius), PLACED)
    places = stored(places, "vector-places")
    own = F.col("cell") == F.col("home")
    size = places.groupBy("label", "cell").agg(F.count_if(~own).alias("queries"), F.count_if(own).alias("entries"))
    blocks = size.where("entries > 0").select("label", "cell", F.ceil(F.col("entries") / BLOCK).cast("int").alias("nl"), F.ceil(F.col("queries") / BLOCK).cast("int").alias("nq"))
    sized = places.join(stored(blocks, "vector-blocks"), ["label", "cell"])
    sliced = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)))
    common = ["label", "cell", "key", "n", "vec", "codes", "missed"]
    # entries with entries: pairs of blocks, a block with itself once
    among = sized.where(own).select(*common, sliced("nl").alias("b"), every("nl").alias("o"))
    among = among.select(*common, F.least("b", "o").alias("l"), F.greatest("b", "o").alias("q"), (F.col("b") > F.col("o")).alias("is_query"), F.lit(False).alias("foreign"))
    # entries with the queries of other lists
    entries = sized.where(own).select(*common, sliced("nl").alias("l"), every("nq").alias("q"), F.lit(False).alias("is_query"), F.lit(True).alias("foreign"))
    queries = sized.where(~own).select(*common, every("nl").alias("l"), sliced("nq").alias("q"), F.lit(True).alias("is_query"), F.lit(True).alias("foreign"))
    both = among.unionByName(entries).unionByName(queries)
    return both.groupBy("label", "cell", "l", "q", "foreign").applyInPandas(_compare(index, cosine, radius), "a binary, b binary, n long")


#: The same in DuckDB's SQL, for small tables of whole vectors: all pairs of a label, and reachability. Meant for tests.
SQL = """
WITH RECURSIVE vectors AS MATERIALIZED (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), links AS MATERIALIZED (
  SELECT a.vec_id AS x, b.vec_id AS y FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.98e0
), reach AS (
  SELECT vec_id, vec_id AS r FROM vectors UNION SELECT reach.vec_id, links.y FROM reach JOIN links ON links.x = reach.r
), roots AS (
  SELECT vec_id, min(r) AS component_id FROM reach GROUP BY 1
), counts AS (
  SELECT x AS vec_id, count(*) AS n FROM links GROUP BY 1
)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM roots LEFT JOIN counts USING (vec_id)
"""
