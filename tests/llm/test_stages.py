"""The stages and verdicts that SQL can't express, against plain Python."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from tessera.llm.common import hashes, mix, table

SF = "/root/testdata/sf0.01"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _stage(name):
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES)[name]


@pytest.mark.parametrize("where", ["fixture", "sf0.01"])
def test_quality_verdicts_n_gram_by_n_gram(spark, docs, labels, where):
    from tessera.llm import quality_rules as rules

    documents, marks = (docs, labels) if where == "fixture" else (table(spark, SF, "documents"), table(spark, SF, "labels"))
    rows = [(r.doc_id, (r.text or "").encode()) for r in documents.select("doc_id", "text").collect()]
    good = {r.doc_id for r in marks.collect() if r.quality == 1 and not r.toxic and r.doc_id is not None}
    words = sorted({w for _, t in rows for w in WORD.findall(t)})
    value = dict(zip(words, hashes(pa.array(words, pa.large_binary())).tolist()))
    bits = 64 - rules.BUCKET_BITS

    def grams(text):
        h = [value[w] for w in WORD.findall(text)]
        pairs = mix(np.array(h[:-1], np.uint64) * np.uint64(3) + np.array(h[1:], np.uint64)).tolist() if len(h) > 1 else []
        return [x >> bits for x in h + pairs]

    raw, target = Counter(), Counter()
    for d, t in rows:
        raw.update(g := grams(t))
        target.update(g if d in good else ())
    share = sum(target.values()) / sum(raw.values())
    ratio = lambda g: math.log((target[g] + rules.ALPHA) / (raw[g] * share + rules.ALPHA))
    want = sorted((str(d), len(t), round(sum(map(ratio, g)) / max(1, len(g)), 6)) for d, t in rows for g in [grams(t)])
    got = rules.apply(documents, rules.fit(documents, marks), keep=["doc_id", "text"]).collect()
    assert sorted((str(r.doc_id), len((r.text or "").encode()), round(r.log_ratio, 6)) for r in got) == want
    assert all(r.kept == (not r.base_failed and r.log_ratio >= rules.THRESHOLD) for r in got)


def test_quality_rules_count_their_target_from_all_trusted_rows(spark, docs, labels):
    from pyspark.sql import functions as F

    from tessera.llm import quality_rules as rules

    many = spark.range(25_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word of "), (F.col("id") % 3000).cast("string")).alias("text"))
    model = rules.fit(many, many.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")))
    assert not model.log_ratio.any()  # every text is trusted: both counts are the same
    # joined to the texts, as beyond TRUSTED_SENT, they are counted alike
    assert np.array_equal(rules.fit(docs, labels, sent=0).log_ratio, rules.fit(docs, labels).log_ratio)


def _scores(model, rows):
    def size(text, content):
        book = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=9, dict_data=book, write_checksum=False, write_content_size=False).compress(text)) if text else 0

    feature = lambda t: (size(t, model.bad) - size(t, model.good)) / max(1, len(t))
    return [(d, 1 / (1 + math.exp(-(feature(t) * model.slope + model.offset)))) for d, t in rows]


def test_the_classifier_and_its_stage_text_by_text(spark):
    """Scores and verdicts from the two dictionaries, one text at a time; planted bad rows go."""
    from tessera.llm import quality_classifier as classifier

    documents, marks = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = classifier.fit(documents, marks)
    want = _scores(model, [(r.doc_id, (r.text or "").encode()) for r in documents.select("doc_id", "text").collect()])
    got = {r.doc_id: r for r in classifier.quality_classifier(documents, marks).collect()}
    assert all(math.isclose(got[d].score, s, abs_tol=1e-9) and got[d].predicted == (s >= 0.3) for d, s in want)
    kept = {r.doc_id for r in _stage("quality_classifier")(spark, documents, SF).select("doc_id").collect()}
    assert kept == {d for d, s in want if s >= 0.3} and 0 < len(kept) < len(want)
    bad = documents.join(marks.where("quality = 0").select("doc_id"), "doc_id", "left_semi")
    assert _stage("quality_classifier")(spark, bad, SF).count() < 0.5 * bad.count()
    assert _stage("quality_classifier")(spark, documents.limit(0), SF).count() == 0


def test_the_classifier_learns_each_id_once(spark):
    """Repeated ids, with other texts, and clashing columns in the labels change neither bounds nor rows out."""
    from tessera.llm.quality_classifier import quality_classifier

    rows = [(d, f"good prose about rivers and fields, number {d} {k}") for d in range(40) for k in range(2)] + [(d, f"BUY!! CLICK >> {d}{k} $$$" * 3) for d in range(40, 80) for k in range(5)]
    marks = spark.createDataFrame([(d, int(d < 40), "x", 0.5, "t") for d in range(80)], "doc_id long, quality int, __id string, feature double, text string")
    got = quality_classifier(spark.createDataFrame(rows, "doc_id long, text string"), marks).collect()
    assert len(got) == len(rows) and np.mean([r.predicted == (r.doc_id < 40) for r in got]) > 0.9


def test_the_packing_stage(spark, docs, tmp_path):
    import public_tokenizers as tok
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tok.path("byte_bpe_50k.json"))
    unique = docs.where("doc_id is not null and doc_id <> 21")
    pieces = defaultdict(list)
    for r in _stage("packing")(spark, unique, str(tmp_path)).collect():
        pieces[r.doc_id].append(r)
    for r in unique.collect():
        ids, at = np.array([*whole.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for p in sorted(pieces[r.doc_id], key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes())) and p.offset + p.length <= 2048
            at += p.length
        assert at == len(ids)
    assert _stage("packing")(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_texts_beyond_a_chunk_are_counted_whole(spark):
    """Texts of five million bytes, past the four that are taken at once, in rules and language model."""
    from tessera.llm import language_model as lm
    from tessera.llm.quality_rules import quality_rules

    rng = np.random.default_rng(4)
    words = np.array(["to", "the", "river", "Über", "#12", "a", "field&"])
    long = "\n".join(" ".join(words[rng.integers(0, len(words), 20)]) for _ in range(60_000))
    rows = [(1, long), (2, "the river"), (9, long[::-1]), (3, None)]
    documents = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    marks = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    count = {d: len(WORD.findall((t or "").encode())) for d, t in rows}
    got = {r.doc_id: r for r in quality_rules(documents, marks).collect()}
    assert {d: r.n_words for d, r in got.items()} == count and min(len(long), count[1]) > 1_000_000
    assert got[1].word_chars == len(re.sub(r"[\x20\x09-\x0D]", "", long)) and got[1].n_symbols == long.count("#") + long.count("&")
    lines = Counter(long.split("\n"))
    assert got[1].n_dup_lines == sum(n - 1 for n in lines.values())
    scored = {r.doc_id: r for r in lm.score_documents(documents).collect()}
    assert {d: r.n_tokens for d, r in scored.items()} == {d: n + 1 for d, n in count.items()}


def test_near_dedup_sketches_a_batch_in_little_memory():
    import tracemalloc

    from tessera.llm import near_dedup

    rng = np.random.default_rng(5)
    texts = [" ".join(map(str, x)) for x in rng.integers(0, 100_000, (4000, 150))]  # some 3.5 MB
    ids = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], ["doc_id", "text_hash", "text"])
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in near_dedup._sketch(iter([batch]))) == len(texts)
        assert tracemalloc.get_traced_memory()[1] < 40 << 20
    finally:
        tracemalloc.stop()
