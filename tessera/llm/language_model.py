"""LM scoring: a log-bilinear neural model trained with noise-contrastive estimation.

Tokens are the words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, and one end per document. Outputs have two
levels. The TOP most frequent words are classes of their own, the end is one, the other words share BUCKETS
classes by their last bytes. Within a shared class every one of the OWN most frequent words is an output of its
own, and one output stands for all others. The network predicts from the CONTEXT classes before a token: the
weighted sum of their vectors is the hidden vector; times the vectors of the classes, plus biases, it gives the
class, times the vectors of the class's words the word. p(word | context) = p(class | context) *
p(output | class, context) * p(word | output); the first two are normalised by sums over all classes and all
outputs of a class, taken from batched matrix products; words that share an output follow their counts, one
added to each and one for all that is unseen.

Training covers every training document once, wherever it lies, in ROUNDS: a round takes a share of the
documents (by a hash of doc_id and text), each partition runs minibatch AdaGrad on the contrast of its tokens
with shared noise samples, from the same start, and the parameters are averaged by tokens for the next round:
their changes are summed in runs of MERGED partitions first, so that no task reads a number of them that grows
with the input. Partitions of fewer than TRAINED tokens are read together, so what is sent stays a small part of
what is read.

Counts cover all training documents, in a distributed table. Words more frequent than all but HOT others go to
the tasks as a bounded table; a word that isn't among them holds at most 1 / HOT of all tokens, so joining the
rest by word meets no hot key. A word of more than LONGEST bytes goes by its digest, so the table is bounded in
bytes too. Documents with crc32(doc_id) mod 7 = 2 are held out of counts and training.

Cases: a null or empty text is the end alone. Rows with the same doc_id are documents of their own; a null doc_id
falls in the fold of the empty text. Without training tokens N and V are 0, every token is unseen, and the
network is its start. Extra columns are ignored. Texts are taken whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, fold, mix, stored, text_chunks, words_of

SPLIT, HELD_OUT = 7, 2
#: Most words sent to every task with their counts, those of them with an output, and most bytes of a word as itself: bounds, whatever the corpus.
HOT, OWN, LONGEST = 65_536, 32_768, 64
#: Classes: frequent words, shared ones, the end.
TOP, BUCKETS = 96, 159
END = TOP + BUCKETS
CLASSES = END + 1
CONTEXT, WIDTH = 6, 16
#: Noise samples of a class's step and of a word's, tokens of a minibatch; step sizes; averaging rounds; partitions summed at once.
NOISE, WORD_NOISE, BATCH, STEP, WORD_STEP, ROUNDS, MERGED = 32, 16, 1024, 0.3, 0.3, 3, 64
#: Tokens of a round that a partition holds at least, on average, where there are so many.
TRAINED = 1 << 19
#: What the squared gradients start from, of the classes and of the words: the smaller, the larger the first steps.
DAMP = (1e-2, 1e-2)
#: Tokens scored by one matrix product.
ROWS = 512


@dataclass
class Model:
    hot_words: pa.Array
    hot_counts: np.ndarray
    least: int  # the smallest hot count
    tokens: int  # N
    types: int  # V
    ends: int  # training documents
    kind: np.ndarray  # the class of each hot word
    spot: np.ndarray  # its output: outputs of a shared class are first[class] (all words without one) and those after it
    first: np.ndarray  # by class; CLASSES + 1 entries
    other_log: np.ndarray  # log10 of the denominator of the words that share an output, by class
    prior: np.ndarray  # of the classes
    inner: np.ndarray  # of the outputs within their class
    weights: dict[str, np.ndarray] = field(default_factory=dict)


def bucket(words: pa.Array) -> np.ndarray:
    """The shared class of each word, by its last three bytes."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    words = words.cast(pa.large_binary()) if not pa.types.is_large_binary(words.type) else words
    _, where, data = words.buffers()
    ends = np.frombuffer(where, np.int64)[words.offset : words.offset + n + 1]
    data = np.frombuffer(data, np.uint8)
    tail = np.zeros(n, np.uint64)
    for k in range(1, 4):
        has = ends[1:] - ends[:-1] >= k
        tail[has] = tail[has] * np.uint64(256) + data[ends[1:][has] - k].astype(np.uint64)
    return TOP + (mix(tail) % np.uint64(BUCKETS)).astype(np.int64)


def named(words: pa.Array) -> pa.Array:
    """Distinct words as strings, the long ones by a digest."""
    long = np.flatnonzero(pc.binary_length(words).to_numpy(zero_copy_only=False) > LONGEST)
    if len(long):
        values = words.to_pylist()
        for k in long.tolist():
            values[k] = b"\x00" + hashlib.blake2b(values[k], digest_size=16).hexdigest().encode()
        words = pa.array(values, pa.large_binary())
    return words.cast(pa.large_string())


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(word number, distinct words, text) of all tokens in order; an end has the number -1."""
    word, distinct, text = words_of(LOWER[data], offsets)
    n = len(offsets) - 1
    at = np.cumsum(np.bincount(text, minlength=n))
    return np.insert(word, at, -1), named(distinct), np.insert(text, at, np.arange(n))


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c): how often each word occurs in the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                word, distinct, _ = words_of(LOWER[data], offsets)
                yield pa.RecordBatch.from_arrays([named(distinct).cast(pa.string()), pa.array(np.bincount(word, minlength=len(distinct)))], ["word", "c"])

    return docs.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _sequences(data: np.ndarray, offsets: np.ndarray, model: Model):
    """(class, contexts, output or -1, word number, distinct words, their places among the hot or -1, text) of the tokens."""
    word, distinct, text = _tokens(data, offsets)
    place = pc.fill_null(pc.index_in(distinct, value_set=model.hot_words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    hot = place >= 0
    kinds, spots = bucket(distinct), np.zeros(len(distinct), np.int64)
    kinds[hot] = model.kind[place[hot]]
    spots[:] = model.first[kinds]
    spots[hot] = model.spot[place[hot]]
    kind = np.append(kinds, END)[word]  # -1: the end
    spot = np.where((kind >= TOP) & (kind != END), np.append(spots, -1)[word], -1)
    contexts = np.full((len(kind), CONTEXT), END, np.int32)
    for k in range(CONTEXT):
        same = text[k + 1 :] == text[: -k - 1]
        contexts[k + 1 :, k][same] = kind[: -k - 1][same]
    return kind, contexts, spot, word, distinct, place, text


def start(model: Model) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(7)
    near = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    out = {"context": near(CLASSES, WIDTH), "target": near(CLASSES, WIDTH), "scale": np.full((CONTEXT, WIDTH), 0.5, np.float32), "bias": np.log(model.prior).astype(np.float32)}
    # the words start from their counts: vectors of 0, the last column their bias
    return out | {"words": np.concatenate([np.zeros((len(model.inner), WIDTH)), np.log(model.inner)[:, None]], 1).astype(np.float32)}


def _places(contexts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Numbers of (place, class) of some tokens' contexts, a row for each place."""
    return contexts.take(rows, axis=0).T + CLASSES * np.arange(CONTEXT)[:, None]


def _scaled(w: dict[str, np.ndarray]) -> np.ndarray:
    """The vectors of the classes at each place, by the numbers of _places()."""
    return (w["context"] * w["scale"][:, None]).reshape(CONTEXT * CLASSES, WIDTH)


def _up(real: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(real, -30, 30)))  # 1 - p(real)


class Trainer:
    """Noise-contrastive estimation: each token's class against draws from the class prior, its word against draws from its class."""

    def __init__(self, model: Model, rounds: int = 0):
        self.m, self.w = model, {k: v.copy() for k, v in model.weights.items()}
        self.squares = {k: np.full_like(v, DAMP[k == "words"]) for k, v in self.w.items()}
        self.rng, self.seen = np.random.default_rng(11 + rounds), 0
        self.log_noise = np.log(NOISE * model.prior).astype(np.float32)
        self.log_inner = np.log(WORD_NOISE * model.inner).astype(np.float32)
        self.reach = np.cumsum(model.inner)  # rises by 1 a class

    def step(self, kind: np.ndarray, places: np.ndarray) -> None:
        w, n = self.w, len(kind)
        hidden = _scaled(w).take(places, axis=0).sum(0)
        noise = self.rng.choice(CLASSES, NOISE, p=self.m.prior)
        target, others = w["target"].take(kind, axis=0), w["target"][noise]
        real = np.einsum("ij,ij->i", hidden, target) + (w["bias"] - self.log_noise).take(kind)
        fake = hidden @ others.T + (w["bias"] - self.log_noise)[noise]
        up, down = _up(real), -_up(-fake)
        to_hidden = up[:, None] * target + down @ others
        # summed by place and class: both the vectors' and the scales' gradients follow
        by_place = _sums(places.ravel(), to_hidden, CONTEXT * CLASSES).reshape(CONTEXT, CLASSES, WIDTH)
        self._move("context", (by_place * w["scale"][:, None]).sum(0) / n, STEP)
        self._move("scale", (by_place * w["context"]).sum(1) / n, STEP)
        self._move("target", _sums(np.concatenate([kind, noise]), np.concatenate([up[:, None] * hidden, down.T @ hidden]), CLASSES) / n, STEP)
        self._move("bias", np.bincount(np.concatenate([kind, noise]), np.concatenate([up, down.sum(0)]), CLASSES).astype(np.float32) / n, STEP)
        self.seen += n

    def step_words(self, k: int, hidden: np.ndarray, spot: np.ndarray) -> None:
        """One class's words: tokens of the class with their hidden vectors, which are taken as they are, and outputs."""
        lo, hi = int(self.m.first[k]), int(self.m.first[k + 1])
        hidden = np.concatenate([hidden, np.ones((len(spot), 1), np.float32)], 1)
        noise = np.minimum(np.searchsorted(self.reach[lo:hi], self.reach[lo] - self.m.inner[lo] + self.rng.random(WORD_NOISE)), hi - lo - 1)
        table, own = self.w["words"][lo:hi], spot - lo
        target, others = table.take(own, axis=0), table[noise]
        real = np.einsum("ij,ij->i", hidden, target) - self.log_inner.take(spot)
        fake = hidden @ others.T - self.log_inner[lo:hi][noise]
        up, down = _up(real), -_up(-fake)
        gradient = _sums(np.concatenate([own, noise]), np.concatenate([up[:, None] * hidden, down.T @ hidden]), hi - lo) / len(spot)
        self._move("words", gradient, WORD_STEP, slice(lo, hi))

    def _move(self, name: str, g: np.ndarray, step: float, rows: slice = slice(None)) -> None:
        squares, w = self.squares[name][rows], self.w[name][rows]
        squares += g * g
        w += step * g / np.sqrt(squares)

    def learn(self, kind: np.ndarray, contexts: np.ndarray, spot: np.ndarray) -> None:
        order = self.rng.permutation(len(kind))
        for k in range(0, len(kind), BATCH):
            rows = order[k : k + BATCH]
            self.step(kind.take(rows), _places(contexts, rows))
        shared = order[spot[order] >= 0]
        shared = shared[np.argsort(kind[shared].astype(np.uint16), kind="stable")]
        ends = np.searchsorted(kind[shared], np.arange(TOP, END + 1))
        scaled = _scaled(self.w)  # the words' steps leave it as it is
        for k, (a, b) in enumerate(zip(ends, ends[1:])):
            for at in range(a, b, BATCH):
                rows = shared[at : min(b, at + BATCH)]
                self.step_words(TOP + k, scaled.take(_places(contexts, rows), axis=0).sum(0), spot.take(rows))


def _sums(rows: np.ndarray, values: np.ndarray, classes: int) -> np.ndarray:
    """values summed by row number: sorted, then added in runs. The values are taken again and again, if there are more row numbers."""
    rows = rows.astype(np.uint16) if classes < 1 << 16 else rows
    order = np.argsort(rows, kind="stable")
    rows = rows.take(order)
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    values = values.astype(np.float32, copy=False).take(order % len(values) if len(values) < len(order) else order, axis=0)
    pairs = values.view(np.complex64) if values.shape[1] % 2 == 0 else values  # two sums at once
    out = np.zeros((classes, values.shape[1]), np.float32)
    out[rows[first]] = np.add.reduceat(pairs, first, axis=0).view(np.float32)
    return out


def _added(keys: list[str]):
    """Sums of parameter blocks with the same keys."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(v, np.float32) for v in df["value"]], axis=0, dtype=np.float64)
        return pd.DataFrame({k: [df[k].iloc[0]] for k in keys} | {"value": [total.astype(np.float32).tobytes()], "weight": [int(df["weight"].sum())]})

    return run


#: Parameters in a block that is summed by one task.
BLOCK = 1 << 14


def train(docs: DataFrame, model: Model, rounds: int = 0) -> dict[str, np.ndarray]:
    """The parameters after one pass over the texts, from model.weights: those of the partitions averaged by their tokens."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # HOT words at most, and their vectors
    names = sorted(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = Trainer(sent.value, rounds)
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                kind, contexts, spot, *_ = _sequences(data, offsets, sent.value)
                trainer.learn(kind, contexts, spot)
        if trainer.seen:
            flat = np.concatenate([(trainer.w[k] - sent.value.weights[k]).ravel() for k in names]) * np.float32(trainer.seen)
            parts = [flat[k : k + BLOCK].tobytes() for k in range(0, len(flat), BLOCK)]
            run_of = TaskContext.get().partitionId() // MERGED
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int64()), pa.array([run_of] * len(parts), pa.int64()), pa.array(parts, pa.binary()), pa.array([trainer.seen] * len(parts), pa.int64())], ["at", "run", "value", "weight"])

    docs = docs.select("text")
    docs = docs.coalesce(max(1, min(docs.rdd.getNumPartitions(), model.tokens // ROUNDS // TRAINED)))
    sums = docs.mapInArrow(run, "at long, run long, value binary, weight long")
    parts = max(1, docs.rdd.getNumPartitions())
    while parts > MERGED:  # as many levels as there are powers of MERGED in the partitions
        sums = sums.groupBy("at", "run").applyInPandas(_added(["at", "run"]), "at long, run long, value binary, weight long").withColumn("run", F.expr(f"run div {MERGED}"))
        parts //= MERGED
    rows = sums.groupBy("at").applyInPandas(_added(["at"]), "at long, value binary, weight long").collect()  # the parameters, a fixed number
    if not rows:
        return model.weights
    flat = np.concatenate([np.frombuffer(r.value, np.float32) / r.weight for r in sorted(rows, key=lambda r: r.at)])
    out, at = {}, 0
    for k in names:
        v = model.weights[k]
        out[k] = v + flat[at : at + v.size].reshape(v.shape)
        at += v.size
    return out


def _normalised(hidden: np.ndarray, target: np.ndarray, own: np.ndarray) -> np.ndarray:
    """log10 of the softmax of hidden times target (vectors and biases as columns) at the outputs `own`."""
    out, ones = np.empty(len(hidden)), np.ones(target.shape[1], np.float32)
    buffer = np.empty((min(ROWS, len(hidden)), target.shape[1]), np.float32)
    longest = np.sqrt(np.einsum("ij,ij->j", target, target).max())
    starts = target.shape[1] * np.arange(len(buffer))
    near = longest * np.sqrt(np.einsum("ij,ij->i", hidden, hidden).max()) < 59  # no score can be larger; a little less for rounding
    for at in range(0, len(hidden), ROWS):
        h = hidden[at : at + ROWS]
        scores = np.matmul(h, target, out=buffer[: len(h)])
        if not near and ((top := scores.max()) > 60 or top < -60):  # far from normalised: exp() needs help
            scores -= scores.max(1, keepdims=True)
        picked = scores.take(starts[: len(h)] + own[at : at + ROWS])
        np.exp(scores, out=scores)
        out[at : at + ROWS] = (picked - np.log(scores @ ones)) / math.log(10)
    return out


def log_probabilities(kind: np.ndarray, contexts: np.ndarray, spot: np.ndarray, model: Model) -> np.ndarray:
    """log10 of p(class | context) * p(output | class, context), both normalised."""
    w, out = model.weights, np.empty(len(kind))
    # the bias as one more dimension, so that a product gives whole scores; each place gives its share of the 1
    one = np.full((CLASSES, 1), 1 / CONTEXT, np.float32)
    tables = [np.concatenate([w["context"] * w["scale"][k], one], 1) for k in range(CONTEXT)]
    target = np.ascontiguousarray(np.concatenate([w["target"], w["bias"][:, None]], 1).T)
    hidden = np.empty((len(kind), WIDTH + 1), np.float32)
    for at in range(0, len(kind), 1 << 16):
        c = contexts[at : at + (1 << 16)]
        hidden[at : at + (1 << 16)] = sum(t.take(c[:, k], axis=0) for k, t in enumerate(tables))
    out = _normalised(hidden, target, kind)
    shared = np.flatnonzero(spot >= 0)
    shared = shared[np.argsort(kind[shared].astype(np.uint16), kind="stable")]
    ends = np.searchsorted(kind[shared], np.arange(TOP, END + 1))
    for k, (a, b) in enumerate(zip(ends, ends[1:])):
        lo, hi = int(model.first[TOP + k]), int(model.first[TOP + k + 1])
        if a < b and hi - lo > 1:  # a class without outputs of its own: the one that all share
            rows = shared[a:b]
            out[rows] += _normalised(hidden.take(rows, axis=0), np.ascontiguousarray(w["words"][lo:hi].T), spot[rows] - lo)
    return out


def prepare(train_docs: DataFrame, counts: DataFrame) -> Model:
    """The model before training: counts of the hot words, of the classes and of their outputs."""
    ends = train_docs.count()
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    # the counts from which at most HOT words are left, in steps of an eighth of an octave: no task sorts, or sends more
    step = F.floor(F.log2("c") * 8).cast("int")
    least, left = 1 << 62, HOT
    for r in counts.groupBy(step.alias("step")).agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("step")).collect():
        left -= r.n
        if left < 0:
            break
        least = r.c
    hot = sorted(counts.where(F.col("c") >= least).collect(), key=lambda r: (-r.c, r.word))
    words, c = pa.array([r.word for r in hot], pa.large_string()), np.array([r.c for r in hot], np.int64)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for batch in batches:
            kind = bucket(batch.column(0).cast(pa.large_string()))
            n += np.bincount(kind, batch.column(1).to_numpy(zero_copy_only=False), CLASSES).astype(np.int64)
            v += np.bincount(kind, minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(n), pa.array(v)], ["k", "n", "v"])

    n, v = np.zeros(CLASSES), np.zeros(CLASSES)  # of the words without an output of their own
    for r in counts.where(F.col("c") < least).select("word", "c").mapInArrow(sums, "k long, n long, v long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        n[r.k], v[r.k] = r.n, r.v
    kind = np.concatenate([np.arange(min(TOP, len(hot))), bucket(words)[TOP:]]).astype(np.int64)
    own = np.arange(len(hot))[TOP:OWN]
    n += np.bincount(kind[OWN:], c[OWN:], CLASSES)
    v += np.bincount(kind[OWN:], minlength=CLASSES)
    sizes = np.bincount(kind[own], minlength=CLASSES)
    sizes[TOP:END] += 1
    first = np.concatenate([[0], np.cumsum(sizes)])
    own = own[np.argsort(kind[own], kind="stable")]  # by class, the frequent ones first
    spot = first[kind]
    spot[own] += 1 + np.arange(len(own)) - np.searchsorted(kind[own], kind[own])
    inner = np.zeros(first[-1])
    inner[first[TOP:END]] = n[TOP:END] + 1
    inner[spot[own]] = c[own]
    mass = np.ones(CLASSES)
    mass[: min(TOP, len(hot))] += c[:TOP]
    mass[TOP:END] = np.add.reduceat(inner, first[TOP:END])
    mass[END] = ends + 1
    inner /= np.repeat(mass, sizes)
    model = Model(words, c, least, int(total.n) + ends, int(total.v) + (ends > 0), ends, kind, spot, first, np.log10(n + v + 1), mass / mass.sum(), inner)
    model.weights = start(model)
    return model


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, words array<string>, times array<int>"


def _score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row, what the hot words and the network say, and the other words with their numbers."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, row = sent.value, TaskContext.get().partitionId() << 33
        hot_logs = np.append(np.log10(m.hot_counts + 1.0), [math.log10(m.ends + 1.0), 0.0])  # then the end, then all others
        for batch in batches:
            for at, n, data, offsets in text_chunks(batch.column(2)):
                kind, contexts, spot, word, distinct, place, text = _sequences(data, offsets, m)
                score = log_probabilities(kind, contexts, spot, m)
                which = np.append(np.where(place < 0, len(m.hot_counts) + 1, place), len(m.hot_counts))[word]
                logs = hot_logs[which]
                rare = which == len(m.hot_counts) + 1
                other = (spot >= 0) & (spot == m.first[kind])  # what rare words' counts add comes later
                score[other] += logs[other] - m.other_log[kind[other]]
                by_text = lambda v: np.bincount(text, v, n)  # noqa: B023, E731
                known = by_text((~rare & ((word >= 0) | (m.ends > 0))).astype(float)).astype(np.int64)
                pair, times = np.unique(text[rare] * max(1, len(distinct)) + word[rare], return_counts=True)
                owner, number = pair // max(1, len(distinct)), pair % max(1, len(distinct))
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32))
                words = distinct.take(pa.array(number)).cast(pa.string())
                columns = [pa.array(row + np.arange(n)), *(batch.column(i).slice(at, n) for i in (0, 1)), pa.array(np.bincount(text, minlength=n)), pa.array(known), pa.array(by_text(logs)), pa.array(by_text(score))]
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(ends, words), pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int32)))], [c.split()[0] for c in SCORED.split(", ")])
                row += n

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, SCORED)


def fitted(training: DataFrame, counts: DataFrame) -> Model:
    """The trained model: every document is in one round."""
    model = prepare(training, counts)
    share = F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS))
    for k in range(ROUNDS):
        model.weights = train(training.where(share == k), model, k)
    return model


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", SPLIT) == HELD_OUT).alias("held_out"), "text")
    training = docs.where(~F.col("held_out"))
    counts = stored(count_words(training), "word-counts")
    model = fitted(training, counts)
    scored = stored(_score(docs, model), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", "w.words", "w.times")
    tail = counts.where(F.col("c") < model.least)  # the hot words aren't looked for
    found = rare.join(tail, F.col("words") == F.col("word"))
    sums = found.groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("logs"))
    out = scored.drop("words", "times").join(sums, "row", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * math.log10(model.tokens + model.types + 1)).alias("base_score"), (F.col("score") + logs).alias("score"),
    )
