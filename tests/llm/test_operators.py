"""Each text operator against a brute-force version, on awkward rows and on an empty table."""

import hashlib
import importlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import components as comp
from tessera.llm.common import SPACE, hashes, table, words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_html():
    from tessera.llm.html_text import main_text

    page = """<html><head><title>T</title><style>p{}</style></head><body class="home sidebar-right"><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
    <div class="ad">Buy this now</div><div id="cookie-notice">We use cookies</div><article><h1>Title &amp; more</h1><p><b>One<br>two&nbsp; three<p>Four <i>fi</i>ve<script>x("</p>")</script>
    <ul><li>six<li>seven</ul><form>q</form><aside>side</aside></article><section class="comments"><p>First! What a very long comment this is, longer than the article.</p></section><footer>&copy; us</footer>"""
    assert main_text(page) == "Title & more\n\nOne two three\n\nFour five\n\nsix\n\nseven"
    prose = "<p>" + "A long paragraph of plain prose that says something. " * 5 + "</p>"
    links = "<div>" + "<a href=x>link text</a> " * 20 + "</div>"
    got = main_text(f"<body>{links}<div>{prose}{prose}<p>Short.</p></div>{links}</body>")
    assert got.count("plain prose") == 10 and got.endswith("Short.") and "link" not in got
    for empty in (None, "", "<p>", "<!-- x", "<script>var a", "<div hidden>x</div>"):
        assert main_text(empty) == ""
    assert main_text("plain") == "plain" and main_text("<div>" * 3000 + "deep") == "deep"


def test_html_wrappers_of_the_content():
    from tessera.llm.html_text import main_text

    prose = "<p>" + "A long paragraph of plain prose that says something. " * 5 + "</p>"
    ad = '<div class="ad">Buy this now</div><div class="sidebar"><p>On the side.</p></div>'
    for start, end in (('<div class="content-sidebar-wrap"><main>', "</main></div>"), ('<div class="layout has-sidebar"><article>', "</article></div>"), ('<div id="content" class="no-sidebar">', "</div>"),
                       ('<article><section class="related-work">', "</section></article>"), ('<main><div class="has-sidebar"><article>', "</article></div></main>")):
        got = main_text(f"<body>{ad}{start}{prose}{prose}{end}{ad}</body>")
        assert got.count("plain prose") == 10 and "Buy" not in got and "side." not in got, start
    # marked elements beside the content go as before, with articles in them or longer than it
    for beside in (f'<div class="related"><article>{prose}{prose}</article></div>', f'<section id="comments">{prose * 4}</section>', f"<aside><article>{prose * 4}</article></aside>"):
        assert main_text(f"<body><article><h1>Title</h1><p>The text.</p></article>{beside}</body>") == "Title\n\nThe text."
    deep = '<div class="ad">' * 20_000
    assert main_text(deep + "<main><p>deep</main>") == "deep"


def test_html_table(spark):
    from tessera.llm.html_text import extract

    rows = spark.createDataFrame([(1, "u", "<p>a  b</p>", 1), (1, "u", "<p>a  b</p>", 1), (None, None, None, 2)], "page_id long, url string, html string, text int")
    assert sorted((tuple(r) for r in extract(rows).collect()), key=repr) == [(1, "u", "a b", 3), (1, "u", "a b", 3), (None, None, "", 0)]
    assert extract(rows.limit(0)).count() == 0


def _rotated(rows):
    """Whole dialogues: (conversation, speaker) to text and mask; a message without a place is one of its own."""
    convs = defaultdict(set)
    for c, t, role, text in rows:
        convs[(c, None) if c is not None and t is not None else (c, (t, role, text))].add((t, role or "unknown", text or ""))
    out = []
    for (c, _), turns in convs.items():
        for me in {r for _, r, _ in turns} - {"system"}:
            text, mask = "", []
            for _, r, x in sorted(turns, key=lambda x: (x[0] or 0, x[1], x[2])):
                head = "<|im_start|>assistant\n" if r == me else "<|im_start|>system\n" if r == "system" else f"<|im_start|>user name={r}\n"
                if r == me:
                    mask.append((len(text) + len(head), len(text) + len(head) + len(x) + 10))
                text += head + x + "<|im_end|>\n"
            out.append((c, me, len(turns), len(mask), text, mask))
    return sorted(out, key=repr)


def test_chat(spark, monkeypatch):
    from tessera.llm import chat_format as chat

    monkeypatch.setattr(chat, "BLOCK", 2)  # several windows a dialogue
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hé ☃"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 2, "ann", "tie"), (1, 130, "cid", "late"), (2, None, None, "x"), (2, 0, "ann", ""), (None, 3, "ann", "no conversation"), (3, 0, "system", "alone"), (4, -1, "ann", "before")]
    rows += [(None, None, "ann", f"{k}") for k in range(20)] + [(None, None, "system", "s"), (None, 3, "ann", "no conversation")]
    rows += [(5, t, "ab"[t % 2], f"turn {t} " * 9) for t in range(300)] + [(6, 5, "ann", "long " * 300_000), (6, 70, "bob", "é" * 1_200_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, speaker int").repartition(3)
    pieces = chat.rotate(df)
    got = [(r.conv_id, r.speaker, r.n_turns, r.n_own, r.text, [tuple(s) for s in r.mask]) for r in chat.whole(pieces).collect()]
    assert sorted(got, key=repr) == _rotated(rows)
    assert all(text[a:b].endswith("<|im_end|>") and text[:a].endswith("<|im_start|>assistant\n") for *_, text, mask in got for a, b in mask)
    # a dialogue of 300 turns lies in five pieces, each where it belongs
    five = sorted((r.piece, r.start, r.text) for r in pieces.where("conv_id = 5 and speaker = 'a'").collect())
    (text,) = (t for c, me, _, _, t, _ in got if (c, me) == (5, "a"))
    assert len(five) == 5 and all(text[at : at + len(t)] == t for _, at, t in five)
    assert chat.rotate(df.limit(0)).count() == 0


def test_language_model(spark, docs):
    from tessera.llm import language_model as lm

    got = defaultdict(list)
    for r in lm.score_documents(docs).collect():
        got[r.doc_id].append(r)
    tokens = [(d, [*WORD.findall((t or "").translate(LOW)), None]) for d, t in pairs(docs)]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    c = Counter(w for d, x in tokens if not held(d) for w in x)
    n, v = sum(c.values()), len(c)
    want = defaultdict(list)
    for d, x in tokens:
        want[d].append((held(d), len(x), sum(c[w] > 0 for w in x), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x), 4)))
    assert {d: sorted((r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rs) for d, rs in got.items()} == {d: sorted(x) for d, x in want.items()}
    assert all(r.score < 0 for rs in got.values() for r in rs)
    assert lm.score_documents(docs.limit(0)).count() == 0


def test_language_model_scores_word_by_word(spark, monkeypatch):
    """The model's probabilities of whole texts, from its parameters in plain Python; normalised after training; better than the base."""
    from tessera.llm import language_model as lm

    monkeypatch.setattr(lm, "HOT", 2000)  # words beyond the table
    monkeypatch.setattr(lm, "OWN", 1200)  # and words of it without an output
    seen, fitted = [], lm.fitted
    monkeypatch.setattr(lm, "fitted", lambda *a: seen.append(fitted(*a)) or seen[0])
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, "w" * 100 + " and then " + "W" * 100), (-2, None)], "doc_id long, text string"))
    rows = {r.doc_id: r for r in lm.score_documents(docs).collect()}
    (m,) = seen
    texts = {d: WORD.findall((t or "").translate(LOW)) for d, t in pairs(docs)}
    name = lambda w: w if len(w.encode()) <= 64 else "\0" + hashlib.blake2b(w.encode(), digest_size=16).hexdigest()
    counts = Counter(name(w) for d, x in texts.items() if zlib.crc32(str(d).encode()) % 7 != 2 for w in x)
    place = {w: k for k, w in enumerate(m.hot_words.to_pylist())}
    import pyarrow as pa

    suffix = dict(zip(all_words := sorted({name(w) for x in texts.values() for w in x}), lm.bucket(pa.array(all_words, pa.large_string())).tolist()))
    kind = lambda w: lm.END if w is None else int(m.kind[place[w]]) if w in place else suffix[w]
    output = lambda w: int(m.spot[place[w]] - m.first[suffix[w]]) if w in place else 0
    rest = defaultdict(list)
    for w, c in counts.items():
        if kind(w) >= lm.TOP and not output(w):
            rest[suffix[w]].append(c)
    assert any(w in place for w in counts if kind(w) >= lm.TOP and not output(w)) and any(w not in place for w in counts)
    w64 = {k: v.astype(float) for k, v in m.weights.items()}

    def softmax(x):
        return np.exp(x - x.max()) / np.exp(x - x.max()).sum()

    def log_p(w, context):
        h = sum(w64["scale"][k] * w64["context"][c] for k, c in enumerate(context))
        k = kind(w)
        out = math.log10(softmax(w64["target"] @ h + w64["bias"])[k])
        if lm.TOP <= k < lm.END:
            inner = w64["words"][m.first[k] : m.first[k + 1]]
            out += math.log10(softmax(inner[:, :-1] @ h + inner[:, -1])[output(w)])
            if not output(w):
                out += math.log10((counts[w] + 1) / (sum(rest[k]) + len(rest[k]) + 1))
        return out

    for d in [-1, -2, *sorted(d for d in texts if 20 < len(texts[d]) < 200)[:12]]:
        tokens = [*map(name, texts[d]), None]
        want = sum(log_p(w, [kind(tokens[i - k]) if i >= k else lm.END for k in range(1, lm.CONTEXT + 1)]) for i, w in enumerate(tokens))
        assert math.isclose(rows[d].score, want, rel_tol=1e-3, abs_tol=1e-2), d
    rng = np.random.default_rng(0)
    context = np.repeat(rng.integers(0, lm.CLASSES, (5, lm.CONTEXT)), lm.CLASSES, 0)
    p = 10 ** lm.log_probabilities(np.tile(np.arange(lm.CLASSES), 5), context, np.full(5 * lm.CLASSES, -1), m)
    assert np.allclose(p.reshape(5, -1).sum(1), 1, atol=1e-4)
    k = lm.TOP + int(np.argmax(np.diff(m.first)[lm.TOP : lm.END]))
    outputs = np.arange(m.first[k], m.first[k + 1])
    context = np.repeat(rng.integers(0, lm.CLASSES, (1, lm.CONTEXT)), len(outputs), 0)
    both = [10 ** lm.log_probabilities(np.full(len(outputs), k), context, s, m) for s in (outputs, np.full(len(outputs), -1))]
    assert len(outputs) > 5 and math.isclose((both[0] / both[1]).sum(), 1, abs_tol=1e-4)
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_learns_from_more(spark):
    """Held-out log10 a token at sf0.01: above the base, and above the model before training."""
    from pyspark.sql import functions as F

    from tessera.llm import language_model as lm

    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    r = lm.score_documents(docs).where("held_out").agg(*(F.sum(c).alias(c) for c in ("score", "base_score", "n_tokens"))).first()
    assert r.score / r.n_tokens > r.base_score / r.n_tokens + 0.08


def test_quality_classifier(spark, docs, labels):
    from tessera.llm.quality_classifier import quality_classifier

    got = quality_classifier(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 0) for r in got)
    assert all(r.score > 0.5 for r in quality_classifier(docs, labels.where("quality = 1")).collect())
    assert quality_classifier(docs.limit(0), labels).count() == 0 and quality_classifier(docs, labels.limit(0)).count() == docs.count()


def test_quality_classifier_on_held_out_labels(spark):
    from tessera.llm.quality_classifier import quality_classifier

    sf = "/root/testdata/sf0.1"
    scored = quality_classifier(table(spark, sf, "documents"), table(spark, sf, "labels")).where("held_out").join(table(spark, sf, "labels"), "doc_id").where("quality is not null").collect()
    y, s = np.array([r.quality for r in scored]), np.array([r.score for r in scored])
    rank = s.argsort().argsort()
    auc = (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert auc > 0.97 and ((s >= 0.3) == y).mean() > 0.95 and (s[y == 1] >= 0.3).mean() > 0.97


def test_quality_classifier_decides_on_few_labels(spark):
    """282 and 47 rows to learn from: some of each label stay for the calibration."""
    from tessera.llm.quality_classifier import quality_classifier

    sf = "/root/testdata/sf0.01"
    scored = quality_classifier(table(spark, sf, "documents"), table(spark, sf, "labels")).where("held_out").join(table(spark, sf, "labels"), "doc_id").where("quality is not null").collect()
    y, s = np.array([r.quality for r in scored]), np.array([r.score for r in scored])
    assert len(set(s)) > 1 and ((s >= 0.3) == y).mean() > 0.9 and (s[y == 0] < 0.3).mean() > 0.5 and (s[y == 1] >= 0.3).mean() > 0.97


def _deduped(rows):
    lines = [(d, (t or "").split("\n")) for d, t in rows]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    holders = defaultdict(list)
    for d, x in lines:
        for k in {key(i) for i in x if len(key(i)) >= 40}:
            holders[k].append(-(1 << 63) if d is None else d)
    out = []
    for d, x in lines:
        kept = [i for i in x if not (len(holders[key(i)]) >= 5 and max(holders[key(i)]) != d)]
        out.append((d, len(x), len(x) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_line_dedup(spark, docs):
    from tessera.llm.line_dedup import LineRuns, dedup_lines

    got = [(r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in dedup_lines(docs).collect()]
    assert sorted(got, key=repr) == _deduped(pairs(docs)) and any(r[2] for r in got)
    assert dedup_lines(docs.limit(0)).count() == 0
    runs = LineRuns(2)
    for k in range(5):  # batches of hashes: some new, some seen, some settled
        runs.add(spark.createDataFrame([(h, h, 10 - k) for h in range(k, k + 3)], "h1 long, h2 long, doc_id long"))
    assert [r is None for r in runs.levels] == [False, True, False]  # five runs: one of level 0, one of four
    assert sorted((r.h1, r.top) for r in runs.frequent().collect()) == [(1, 10), (2, 10), (3, 9), (4, 8), (5, 7)]


def test_line_runs_meet_without_an_exchange(spark):
    """A merge of runs reads them as they lie: sort-merge joins, no exchange, no sort."""
    from tessera.llm.line_dedup import LineRuns
    from tessera.sources.shared import merging

    rows = lambda k: spark.range(k, k + 5000).selectExpr("xxhash64(id) as h1", "xxhash64(id, 1) as h2", f"{9 - k} as doc_id")
    runs = LineRuns(2)
    for k in range(3):
        runs.add(rows(k))
    with merging(spark):
        merged = runs.frequent()
        plan = merged._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
        assert merged.count() == 5000


def test_line_dedup_of_repeated_ids_null_ids_and_a_long_text(spark):
    """The operator, the SQL and brute force agree where rows share an id, have none, or drop very many lines."""
    import duckdb
    import pandas as pd

    from tessera.llm.line_dedup import SQL, dedup_lines

    common = [f"line {k} of a long list that many of these documents hold, word for word" for k in range(20_000)]
    rows = [(k, "\n".join(common[:3])) for k in range(4)] + [(4, common[0] + "\nown"), (4, common[0]), (4, "else")]
    rows += [(None, "\n".join(common[1:4] + [f"a{k}"])) for k in range(30)] + [(d, "\n".join(common)) for d in range(10, 16)]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got), key=repr)
    assert got == _deduped(rows) and sum(r[2] for r in got) > 100_000
    con = duckdb.connect()
    con.register("given", pd.DataFrame({"doc_id": pd.array([d for d, _ in rows], "Int64"), "text": [t for _, t in rows]}))
    con.execute("CREATE TABLE documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text FROM given")
    assert got == sorted(con.execute(SQL).fetchall(), key=repr)


def _classes(rows, threshold=0.8):
    sets, texts = [], []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        texts.append(tuple(w))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if texts[i] == texts[j] or sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
                up[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[find(i)].append(d)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return sorted(((d, least[find(i)], len(ids[find(i)])) for i, (d, _) in enumerate(rows)), key=repr)


def test_near_dedup(spark, docs):
    from tessera.llm.near_dedup import near_dedup

    got = sorted(((r.doc_id, r.class_id, r.n_copies) for r in near_dedup(docs).collect()), key=repr)
    assert got == _classes(pairs(docs))
    assert near_dedup(docs.limit(0)).count() == 0


def test_near_dedup_of_a_large_group(spark):
    """Copies with edits, many below the threshold to the original: buckets that need the comparison by blocks."""
    from tessera.llm.near_dedup import near_dedup

    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(150)]
    rows = []
    for d in range(120):
        own = list(words)
        for at in rng.choice(150, int(rng.integers(0, 12)), replace=False):
            own[at] = f"x{rng.integers(1 << 30)}"
        rows.append((d, " ".join(own)))
    got = sorted(((r.doc_id, r.class_id, r.n_copies) for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()), key=repr)
    assert got == _classes(rows)


def test_near_dedup_finds_what_an_index_of_all_shingles_finds(spark):
    """Every row whose id is divisible by 50 against all 10,000: no pair at 0.8 or more ends in two classes."""
    from tessera.llm.common import text_chunks
    from tessera.llm.near_dedup import near_dedup, shingle

    docs = table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text")
    classes = {r.doc_id: r.class_id for r in near_dedup(docs).collect()}
    rows = docs.toArrow()
    ids, sets = rows["doc_id"].to_pylist(), []
    for _, n, data, offsets in text_chunks(rows["text"]):
        owner, value, *_ = shingle(data, offsets)
        sets += np.split(value, np.searchsorted(owner, np.arange(1, n)))
    holders = defaultdict(list)
    for k, values in enumerate(sets):
        for v in values.tolist():
            holders[v].append(k)
    found = missed = 0
    for k, values in enumerate(sets):
        if ids[k] % 50 == 0:
            for j, common in Counter(j for v in values.tolist() for j in holders[v] if j != k).items():
                if common >= 0.8 * (len(values) + len(sets[j]) - common) - 1e-9:
                    found += 1
                    missed += classes[ids[k]] != classes[ids[j]]
    assert found > 50 and missed == 0


def test_near_dedup_whatever_the_repeat_counts(spark):
    """Of 100 shingles a copy repeats 20 a thousand times: the sets are 0.96 alike, the weighted ones half as much."""
    from tessera.llm.near_dedup import near_dedup

    rows = []
    for d in range(0, 24, 2):
        words = [f"w{d}x{i}" for i in range(104)]
        rows += [(d, " ".join(words)), (d + 1, " ".join(words + words[-24:] * 999))]
    got = sorted(((r.doc_id, r.class_id, r.n_copies) for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == _classes(rows) and all(n == 2 for _, _, n in got)


def test_probminhash_estimates_the_similarity():
    from tessera.llm.near_dedup import signatures

    a, b = np.arange(1, 1001, dtype=np.uint64), np.arange(201, 1201, dtype=np.uint64)
    from tessera.llm.common import mix

    values = mix(np.concatenate([a, b]))
    sig = signatures(np.repeat([0, 1], 1000), values, np.ones(2000), 2, 2000)
    assert abs((sig[0] == sig[1]).mean() - 800 / 1200) < 0.05
    heavy = signatures(np.array([0, 0]), mix(np.array([1, 2], np.uint64)), np.array([1.0, 3.0]), 1, 4000)
    assert abs((heavy == mix(np.array([2], np.uint64))[0]).mean() - 0.75) < 0.04


def test_quality_rules(spark, docs, labels):
    from tessera.llm.quality_rules import quality_rules

    got = sorted((tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in quality_rules(docs, labels).collect()), key=repr)
    want = []
    for d, t in [*pairs(docs)]:
        w = WORD.findall(t or "")
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = Counter(x for x in (t or "").split("\n") if WORD.search(x))
        want.append((d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), sum(n - 1 for n in lines.values()), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)))
    assert got == sorted(want, key=repr)
    assert quality_rules(docs.limit(0), labels).count() == 0
    none = quality_rules(docs, labels.limit(0)).collect()
    assert all(r.kept != r.base_failed and r.log_ratio == 0 for r in none)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_quality_rules_keep_good_and_reject_bad(spark, sf):
    from tessera.llm.quality_rules import quality_rules

    sf = f"/root/testdata/{sf}"
    rows = quality_rules(table(spark, sf, "documents"), table(spark, sf, "labels")).join(table(spark, sf, "labels"), "doc_id").where("not base_failed and quality is not null").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    # 71 good and 6 bad texts are little to learn from
    assert np.mean(good) > 0.99 and np.mean(bad) < (0.5 if sf.endswith("sf0.001") else 0.1)


def test_bpe(spark, docs):
    import base64

    import public_tokenizers as tok
    import tiktoken

    from tessera.llm.bpe import Bpe, encode_documents

    path = tok.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(path, "rb"))}
    whole = tiktoken.Encoding("x", pat_str=tok.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = sorted((tuple(r) for r in encode_documents(docs, path, tok.PATTERN).collect()), key=repr)
    want = []
    for d, t in pairs(docs):
        ids = np.array(whole.encode_ordinary(t or ""), "<u4")
        want.append((d, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert encode_documents(docs.limit(0), path, tok.PATTERN).count() == 0
    b = Bpe(open(path, "rb").read(), tok.PATTERN)
    for s in ("a\u0085b\x1c c", "  \n\n x", "é" * 90, "ab" * 500, "<|endoftext|>", "1234 ٣٤ 'll'LL"):
        (ids,) = b.encode([s])
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode_ordinary(s) and b.decode([ids]) == [s.encode()]


def long_texts():
    """Texts of over four million characters: with line breaks, without, and with few places to part them."""
    rng = np.random.default_rng(9)
    words = np.array(["to", "the", "river", "Über", "señor", "☃", "12", "it's", "--", "a.b"])
    prose = "\n".join(" ".join(words[rng.integers(0, len(words), 12)]) for _ in range(90_000))
    return [(1, prose), (2, "x" * 200_000 + " " + prose.replace("\n", " ")), (3, prose.replace("\n", " \n ")), (4, "short"), (5, prose[:1_500_000] + "\n\n" + prose[:1_500_000])]


def test_long_texts_are_encoded_and_packed_whole(spark):
    import base64

    import public_tokenizers as tok
    import tiktoken
    from tokenizers import Tokenizer

    from tessera.llm.bpe import encode_documents
    from tessera.llm.packing import pack

    rows = long_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = tok.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(path, "rb"))}
    whole = tiktoken.Encoding("x", pat_str=tok.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for d, t in rows:
        ids = np.array(whole.encode_ordinary(t), "<u4")
        want.append((d, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(tuple(r) for r in encode_documents(docs, path, tok.PATTERN).collect()) == want
    json_path, ranks_path = tok.path("byte_bpe_50k.json"), tok.path("byte_bpe_50k.tiktoken")
    tokenizer = Tokenizer.from_file(json_path)
    pieces = defaultdict(list)
    for r in pack(docs, json_path, ranks_path, tok.PATTERN).collect():
        pieces[r.doc_id].append(r)
    for d, t in rows:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_the_ranks_give_the_ids_of_the_tokenizer():
    """Every code point, alone and between others: the two files of one vocabulary agree."""
    import public_tokenizers as tok
    from tokenizers import Tokenizer

    from tessera.llm.packing import Encoder

    path = tok.path("byte_bpe_50k.json")
    fast, whole = Encoder(open(path).read(), open(tok.path("byte_bpe_50k.tiktoken"), "rb").read(), tok.PATTERN), Tokenizer.from_file(path)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [f" {c}".join(points[k : k + 512]) if k % 1024 else "".join(points[k : k + 512]) for k in range(0, len(points), 512) for c in ("a ",)]
    for text, want in zip(texts, whole.encode_batch(texts, add_special_tokens=False)):
        assert fast(text) == want.ids


def _cosines(rows):
    out = {}
    unit = {}
    for i, (_, x, label) in enumerate(rows):
        x = None if x is None or label is None or any(v is None for v in x) else np.array(x, float)
        if x is not None and len(x) and np.isfinite(x).all() and x.any():
            unit[i] = (label, x / np.linalg.norm(x))
    link = {i: [j for j, (m, y) in unit.items() if j != i and m == unit[i][0] and len(y) == len(unit[i][1]) and unit[i][1] @ y >= 0.98] for i in unit}
    for i, (v, *_) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in link.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (v, len(link.get(i, [])), min((rows[j][0] for j in seen if rows[j][0] is not None), default=None))
    return sorted(out.values(), key=repr)


def test_embeddings(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tessera.llm import embedding_dedup as ed

    monkeypatch.setattr(ed, "BLOCK", 16)  # several lists, several blocks each
    rng = np.random.default_rng(5)
    base = rng.normal(size=(20, 8))
    rows = []
    for i in range(200):
        x = base[i % 20] + rng.normal(size=8) * 0.12
        rows.append((i, [float(np.float32(v)) for v in x], i % 2))
    same = rows[7][1]
    rows += [(300 + i, same, 1) for i in range(40)] + [(400, [2 * v for v in same], 1), (401, same, 0), (402, same, None), (403, None, 1), (404, [], 1), (405, [0.0] * 8, 1), (406, [None] + same[1:], 1)]
    rows += [(407, [float("nan")] + same[1:], 1), (408, [float("inf")] + same[1:], 1), (409, same[:4], 1), (410, same[:4], 1), (300, same, 1), (None, same, 1), (None, None, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, cell int").repartition(5)
    assert sorted((tuple(r) for r in ed.embedding_dedup(df).collect()), key=repr) == _cosines(rows)
    assert ed.embedding_dedup(df.limit(0)).count() == 0
    wide = df.withColumn("embedding", F.col("embedding").cast("array<double>"))
    assert sorted((tuple(r) for r in ed.embedding_dedup(wide).collect()), key=repr) == _cosines(rows)


def test_packing(spark, docs):
    import public_tokenizers as tok
    from tokenizers import Tokenizer

    from tessera.llm.packing import LENGTH, pack

    whole = Tokenizer.from_file(tok.path("byte_bpe_50k.json"))
    special = spark.createDataFrame([(50, "a <|endoftext|> b")], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(special)
    got = pack(both, tok.path("byte_bpe_50k.json"), tok.path("byte_bpe_50k.tiktoken"), tok.PATTERN).collect()
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
        assert r.length > 0
    for rs in sequences.values():
        rs.sort(key=lambda r: r.offset)
        assert [r.offset for r in rs] == list(np.cumsum([0, *(r.length for r in rs[:-1])])) and sum(r.length for r in rs) <= LENGTH
    full = sum(LENGTH if (n := sum(r.length for r in rs)) & (n - 1) else n for rs in sequences.values())
    assert full < 1.05 * sum(r.length for r in got)
    want = Counter()
    for d, t in pairs(both):
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want[d] += len(ids)
        mine = sorted((r for r in got if r.doc_id == d and r.doc_tokens == len(ids)), key=lambda r: r.start)
        if d not in (None, 21):  # those ids are there twice
            assert [r.start for r in mine] == list(np.cumsum([0, *(r.length for r in mine[:-1])]))
            assert [r.ids_crc32 for r in mine] == [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in mine]
    have = Counter()
    for r in got:
        have[r.doc_id] += r.length
    assert have == want
    assert pack(both.limit(0), tok.path("byte_bpe_50k.json"), tok.path("byte_bpe_50k.tiktoken"), tok.PATTERN).count() == 0


def test_cuts_are_the_cheapest():
    from tessera.llm.packing import cut

    rng = np.random.default_rng(1)
    for _ in range(30):
        at = [0, *np.cumsum(rng.integers(1, 9, 12)).tolist()]
        penalty = [0, *rng.choice([0, 4, 24], 12).tolist()]
        found = cut(at, penalty, 16)
        best = {0: 0}
        for i in range(1, len(at)):
            best[i] = min((best[j] + 16 - (at[i] - at[j]) + penalty[i] for j in range(i) if at[i] - at[j] <= 16), default=math.inf)
        last = max(k for k, x in enumerate(found) if x in at and all(y in at for y in found[: k + 1]))
        inner = [k for k in range(len(found)) if found[k] in at and found[k] != at[-1]]
        cost = lambda upto: sum(16 - (b - a) + penalty[at.index(b)] for a, b in zip(found, found[1 : upto + 1]))
        k = inner[-1]
        assert found[0] == 0 and found[-1] == at[-1] and all(b - a <= 16 for a, b in zip(found, found[1:])) and last >= 0
        if all(x in at for x in found[: k + 1]) and len(found) - 1 == k + 1:
            assert math.isclose(cost(k), best[at.index(found[k])])


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (40, 2))] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200 + i) for i in range(1, 30)]
    got = {r.id: r.root for r in comp.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}
    for a, b in edges:
        if a != b:
            x, y = up.setdefault(a, {a}), up.setdefault(b, {b})
            x |= y
            for i in x:
                up[i] = x
    assert got == {k: min(v) for k, v in up.items()}
    assert comp.components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_words_and_hashes():
    data = "a b  c\tab a".encode()
    word, distinct, _ = words_of(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert [distinct.to_pylist()[i] for i in word] == ["a b".encode(), b"c", b"ab", b"a"]
    assert len(set(hashes(distinct).tolist())) == 4 and SPACE.sum() == 6


def test_pipeline(spark, docs, labels, tmp_path):
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} <= {r.doc_id for r in docs.collect()}
    stage, seen = docs, []
    for name, f in corpus_pipeline.STAGES:
        after = f(spark, stage, str(tmp_path))
        seen.append((name, after.count()))
        if name != "packing":
            assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            path = str(tmp_path / name)
            after.write.parquet(path)
            stage = spark.read.parquet(path)
    rows = [r for r in stage.collect() if r.doc_id in (0, 20, 21, 22)]
    assert [r.doc_id for r in rows] in ([0], []), seen  # one of the copies stays
    stages = dict(corpus_pipeline.STAGES)
    cut = [(r.doc_id, hashlib.sha256(r.text.encode()).hexdigest(), r.n_chars == len(r.text)) for r in stages["line_dedup"](spark, docs, str(tmp_path)).collect()]
    assert sorted(cut, key=repr) == sorted(((d, sha, True) for d, _, _, sha in _deduped(pairs(docs))), key=repr)
    left = [r.doc_id for r in stages["near_dedup"](spark, docs, str(tmp_path)).collect()]
    # the null text is a copy of the empty ones; the other null doc_id is a class of its own
    assert sorted(left, key=repr) == sorted({c for _, c, _ in _classes(pairs(docs))}, key=repr)
    for name in ("quality_rules", "line_dedup", "near_dedup"):
        f = dict(corpus_pipeline.STAGES)[name]
        assert f(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_the_pipeline_classifier_learns_from_rows_that_it_is_not_given(spark):
    """The stage gets held-out rows alone: none that it may learn from."""
    import corpus_pipeline
    from tessera.llm.common import fold

    sf = "/root/testdata/sf0.01"
    given = table(spark, sf, "documents").where(fold("doc_id", 5) == 0).join(table(spark, sf, "labels").where("quality is not null").select("doc_id", "quality"), "doc_id")
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["quality_classifier"](spark, given, sf).select("doc_id").collect()}
    rows = [(r.doc_id in kept, r.quality) for r in given.select("doc_id", "quality").collect()]
    assert np.mean([k for k, q in rows if q == 1]) > 0.97 and np.mean([k for k, q in rows if q == 0]) < 0.5


def test_queries_are_registered():
    queries = importlib.import_module("__spark_entry__").queries()
    assert all(any(q.startswith(f"op{n}_") for q in queries) for n in range(1, 11)) and "pipeline" in queries
