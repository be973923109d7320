"""Quality and language models: held-out figures, exact parts against plain forms."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillsieve.llm import lm_scoring, quality, queries

from .helpers import collected, odd_docs


def remainder(i, n):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n


def test_quality_is_right_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op2_quality_classifier(spark, sf).toPandas()
    assert len(rows) == 1000 and rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.5)).all()
    assert all(h == (remainder(i, 3) == 1) for i, h in zip(rows.doc_id, rows.held_out))
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    held = rows[rows.held_out].merge(labels, on="doc_id")
    assert (held.predicted == held.quality).mean() > 0.97


def test_quality_ignores_held_out_labels_and_other_columns(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)] + [(None, 1, 0), (3, None, 0), (4, 7, 0)], "doc_id long, quality int, toxic int")
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality", "toxic")
    a, b = quality.fit(docs, labels), quality.fit(docs, flipped)
    x = quality.statistics([t or "" for _, t in collected(docs)])
    assert np.allclose(a.score(x), b.score(x))
    out = quality.score(docs, a)
    assert out.columns == [c for c in docs.columns if c not in ("score", "predicted")] + ["score", "predicted"] and out.count() == docs.count()
    assert quality.score(docs, quality.fit(docs, labels.limit(0))).where("score <> 0.5").count() == 0
    assert quality.score(docs, quality.fit(docs, labels.where("quality = 1"))).where("score <> 1").count() == 0
    assert quality.fit(docs.limit(0), labels).classes == (None, None)


def test_quality_density_is_gaussian():
    rng = np.random.default_rng(0)
    d = len(quality.NAMES)
    parts, rows = [], []
    for k in (0, 1):
        x = rng.normal(k, 1 + k, (400, d))
        rows.append(x)
        parts.append((400.0, x.sum(0), x.T @ x))
    m = quality._model(parts, 0.1)
    x = rng.normal(0.5, 1.5, (5, d))
    logs = []
    for prior, mean, w, det in m.classes:
        cov = np.linalg.inv(w.T @ w)
        assert np.isclose(np.linalg.slogdet(cov)[1], det)
        logs.append(prior - 0.5 * det - 0.5 * np.einsum("nd,de,ne->n", x - mean, np.linalg.inv(cov), x - mean))
    assert np.allclose(m.score(x), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_lm_base_and_counts(spark):
    docs = odd_docs(spark)
    texts = collected(docs)
    tokens = {k: [*(t or "").encode().lower().split(), b""] for k, (_, t) in enumerate(texts)}
    counts = Counter(w for k, (i, _) in enumerate(texts) if remainder(i, 7) != 2 for w in tokens[k])
    total, distinct = sum(counts.values()), len(counts)
    want = []
    for k, (i, _) in enumerate(texts):
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens[k])
        want.append((repr(i), remainder(i, 7) == 2, len(tokens[k]), sum(counts[w] > 0 for w in tokens[k]), total, round(base, 4)))
    got = lm_scoring.score(docs, chunk_bytes=3000).collect()
    assert sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == sorted(want)
    assert all(r.score <= 1e-9 for r in got)
    assert lm_scoring.score(docs.limit(0)).count() == 0


def test_lm_probabilities_add_up():
    rng = np.random.default_rng(1)
    weights, bias = rng.normal(size=(lm_scoring.FEATURES, lm_scoring.CLASSES)), rng.normal(size=lm_scoring.CLASSES)
    p = np.exp(lm_scoring.log_probabilities(weights, bias, np.arange(0, lm_scoring.CLASSES**2, 97)))
    assert np.allclose(p.sum(1), 1)
    end = lm_scoring.END_CLASS
    assert lm_scoring.contexts(np.array([5, 6, 7, 8, 9]), np.array([0, 3])).tolist() == [c2 * lm_scoring.CLASSES + c1 for c2, c1 in ((end, end), (end, 5), (5, 6), (end, end), (end, 8))]


def test_lm_beats_its_base_on_held_out_rows(spark):
    rows = queries.op10_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out").toPandas()
    assert rows.score.sum() > rows.base_score.sum()


def test_registered_lm_score_is_the_models(spark, sf, monkeypatch):
    """The registered score, token by token: softmax over classes, then add-one counts within the class."""
    held = {}
    train = lm_scoring.train
    monkeypatch.setattr(lm_scoring, "train", lambda *a, **k: held.setdefault("model", train(*a, **k)))
    got = {r.doc_id: r.score for r in queries.op10_lm_scoring(spark, sf).collect()}
    weights, bias = held["model"]
    texts = {i: [*(t or "").encode().lower().split(), b""] for i, t in collected(spark.read.parquet(f"{sf}/documents.parquet"))}
    counts = Counter(w for i, own in texts.items() if remainder(i, 7) != 2 for w in own)
    totals = Counter()
    for w, n in counts.items():
        totals[lm_scoring.token_class(w)] += n + 1
    for i in sorted(texts)[:60]:
        classes = [lm_scoring.token_class(w) for w in texts[i]]
        before = [lm_scoring.END_CLASS, lm_scoring.END_CLASS, *classes]
        context = np.array([two * lm_scoring.CLASSES + one for two, one in zip(before, before[1:])][: len(classes)])
        factor = lm_scoring.log_probabilities(weights, bias, context)[np.arange(len(classes)), classes] / math.log(10)
        within = [0.0 if not w else math.log10((counts[w] + 1) / (totals[c] + 1)) for w, c in zip(texts[i], classes)]
        assert abs(got[i] - (factor.sum() + sum(within))) < 1e-3 * len(classes)


def test_lm_word_tree_adds_up():
    rng = np.random.default_rng(2)
    shares = rng.integers(1, 50, 37)
    paths, every = lm_scoring.tree(shares), np.arange(37)
    one, two = np.full(37, 11, np.uint32), np.full(37, 5, np.uint32)
    assert np.allclose(np.exp(lm_scoring.word_log_probabilities(paths, np.zeros(256), every, one, two)), shares / shares.sum())
    assert np.isclose(np.exp(lm_scoring.word_log_probabilities(paths, rng.normal(size=256), every, one, two)).sum(), 1)


def test_lm_learns_words_before(spark):
    """Words of one class and count, after words of one class and count: only word features tell the pairs apart."""
    rows = [(k, "firstly talking secondly walking " * 20) for k in range(40)]
    asked = [k for k in range(100, 200) if remainder(k, 7) == 2][:4]
    pairs = ["firstly talking", "secondly walking", "firstly walking", "secondly talking"]
    got = {r.doc_id: r.score for r in lm_scoring.score(spark.createDataFrame(rows + list(zip(asked, pairs)), "doc_id long, text string")).collect()}
    seen, turned = [got[k] for k in asked[:2]], [got[k] for k in asked[2:]]
    assert sum(seen) > sum(turned) + 1


@pytest.mark.parametrize("bucket_bytes", [10**9, 300_000])
def test_lm_score_token_by_token(spark, sf, monkeypatch, bucket_bytes):
    """The score from plain tokens: class softmax, bucket's share, and the word tree of each bucket."""
    held = {}
    train = lm_scoring.train
    monkeypatch.setattr(lm_scoring, "train", lambda *a, **k: held.setdefault("model", train(*a, **k)))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r.score for r in lm_scoring.score(docs, bucket_bytes=bucket_bytes).collect()}
    texts = {i: [*(t or "").encode().lower().split(), b""] for i, t in collected(docs)}
    buckets = 1 + sum(len((t or "").encode()) for _, t in collected(docs)) // bucket_bytes
    assert buckets > 1 or bucket_bytes > 10**6
    counts = Counter(w for i, own in texts.items() if remainder(i, 7) != 2 for w in own)
    routes = defaultdict(list)
    for i, own in texts.items():
        before = [b"", b"", *own]
        for two, one, w in zip(before, before[1:], own):
            if w:
                routes[lm_scoring.token_class(w), (zlib.crc32(w) >> 7) * 0x9E3779B1 % 2**32 * buckets >> 32].append((i, w, zlib.crc32(one), zlib.crc32(two)))
    want, mass = Counter(), {}
    for key, rows in routes.items():
        known = sorted({w for _, w, _, _ in rows if counts[w]})
        mass[key] = sum(counts[w] + 1 for w in known) + 1
        number = {w: k for k, w in enumerate(known)}
        paths = lm_scoring.tree(np.array([*(counts[w] + 1 for w in known), 1]))
        leaf = np.array([number.get(w, len(known)) for _, w, _, _ in rows])
        one, two = (np.array([r[k] for r in rows], np.uint32) for k in (2, 3))
        seen = np.array([remainder(r[0], 7) != 2 for r in rows])
        weights = lm_scoring.train_words(paths, leaf, one, two, seen)
        for (i, *_), x in zip(rows, lm_scoring.word_log_probabilities(paths, weights, leaf, one, two)):
            want[i] += x / math.log(10)
    for (c, b), rows in routes.items():
        for i, *_ in rows:
            want[i] += math.log10(mass[c, b] / sum(mass.get((c, k), 0) for k in range(buckets)))
    for i in sorted(texts)[:60]:
        classes = np.array([lm_scoring.token_class(w) for w in texts[i]])
        logs = lm_scoring.log_probabilities(*held["model"], lm_scoring.contexts(classes, np.array([0])))
        assert abs(got[i] - want[i] - logs[np.arange(len(classes)), classes].sum() / math.log(10)) < 1e-3 * len(classes)
