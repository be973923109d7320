"""Suffix-array dedup and the n-gram join against brute force."""

import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillsieve.llm import graph, jaccard_join as J, queries, suffix_dedup as S

from .helpers import collected, odd_docs


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60))
def test_suffix_array(symbols):
    s = [*symbols, 0]
    assert S.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def brute_dedup(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[p : p + length] for r in raw for p in range(len(r) - length + 1))
    out = []
    for r in raw:
        runs = S.merge_spans([(p, p + length) for p in range(len(r) - length + 1) if seen[r[p : p + length]] > 1])
        edges = [0, *(x for y in runs for x in y), len(r)]
        kept = b"".join(r[a:b] for a, b in zip(edges[::2], edges[1::2]))
        out.append((len(r), len(r) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
    return out


def passages(seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9))) for _ in range(50)]
    shared = [" ".join(rng.choice(words) for _ in range(90)) for _ in range(6)]
    texts = ["x" * 1000, "ab" * 700, "", "short", None, "x" * 399, "x" * 400, "ab" * 200]
    for _ in range(120):
        a, b, i = rng.choice(shared), rng.choice(shared), rng.randint(0, 100)
        texts.append(" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) + a[i : rng.randint(300, len(a))] + rng.choice(["", b, "zz"]) + " ".join(rng.choice(words) for _ in range(20)))
    return texts + texts[:9]


@pytest.mark.parametrize("most, length", [(None, 400), (2, 400), (None, 100), (1, 61)])
def test_dedup(spark, most, length):
    texts = passages()
    docs = spark.createDataFrame([(k, t, 5) for k, t in enumerate(texts)], "doc_id long, text string, anchor int")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.dedup(docs, length, most).collect()}
    assert [got[k] for k in range(len(texts))] == brute_dedup(texts, length)


def endings(seed=7):
    """Texts that share only their last 390 bytes, for many endings: anchors at every place modulo 32."""
    rng = random.Random(seed)
    some = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    texts = []
    for _ in range(64):
        end = some(390)
        texts += [some(rng.randint(300, 700)) + end for _ in range(3)]
        body = some(60)
        texts += [some(200) + body + end, some(210) + body + end + some(5)]  # a true repeat beside
    return texts


def test_split_anchors_leave_short_endings(spark):
    texts = endings()
    cut = S._fragments(400)
    batch = S.pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    rows = [r for b in cut([batch]) for r in b.to_pylist() if r["anchor"] is not None]
    assert {(r["at"] if "at" in r else 0) % 32 for r in rows} == set(range(32))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.dedup(docs, 400, 1).collect()}
    assert [got[k] for k in range(len(texts))] == brute_dedup(texts, 400)


def test_dedup_odd_rows(spark):
    docs = odd_docs(spark)
    texts = collected(docs)
    want = sorted((repr(i), *x) for (i, _), x in zip(texts, brute_dedup([t for _, t in texts], 400)))
    assert sorted((repr(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.dedup(docs).collect()) == want
    assert S.dedup(docs.limit(0)).count() == 0


def test_dedup_query(spark, sf):
    texts = dict(collected(spark.read.parquet(f"{sf}/documents.parquet")))
    want = dict(zip(texts, brute_dedup(list(texts.values()), 400)))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op5_suffix_dedup(spark, sf).collect()} == want


def brute_components(rows, n, percent):
    """By smallest id; rows of one id are one vertex."""
    sets = [(i, J.shingles(J.words_of(t or ""), n)) for i, t in rows]
    top = {i: i for i, _ in sets if i is not None}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    live = [(i, s) for i, s in sets if i is not None and s]
    for k, (i, a) in enumerate(live):
        for j, b in live[:k]:
            if J.similar(a, b, percent):
                x, y = sorted((find(i), find(j)))
                top[y] = x
    return sorted((repr(i), len(s), repr(None if i is None else find(i) if s else i)) for i, s in sets)


def near_copies(seed=5):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([2, 3, 4, 5, 8, 14, 30, 60, 120, 300]))]
        for _ in range(rng.randint(1, 9)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append(" ".join(own[rng.choice([0, 0, 1]) :]))
    return [(k, t) for k, t in enumerate(rng.sample(rows, len(rows)))]


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80), (1, 60), (2, 50)])
def test_join(spark, n, percent):
    rows = near_copies() + [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (5, "same id other text"), (906, "same id other text"), (None, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in J.link(docs, n, percent).collect())
    assert got == brute_components(rows, n, percent)


def test_join_needs_no_hub(spark):
    """All pairs of what is still apart: the same components without hubs."""
    rows = near_copies(8)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in J.link(docs, 3, 80, hubs=0).collect()) == brute_components(rows, 3, 80)


def close_misses(seed=9, groups=3, size=40):
    """Texts of groups that share most words, at similarities around 0.8: many pairs just below, some above."""
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"g{g}w{k}" for k in range(150)]
        for v in range(size):
            own = list(base)
            for k in range(rng.randint(1, 4)):
                own[rng.randrange(len(own))] = f"v{g}x{v}y{k}"
            rows.append(" ".join(own))
    return list(enumerate(rng.sample(rows, len(rows))))


def test_join_of_close_misses(spark, monkeypatch):
    """Same components, and few pairs of the last phase come to be verified."""
    rows, asked, wide = close_misses(), [], J._wide
    monkeypatch.setattr(J, "_wide", lambda pairs, *a: asked.append(pairs.count()) or wide(pairs, *a))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for hubs in (0, 2):
        asked.clear()
        got = sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in J.link(docs, 5, 80, hubs=hubs).collect())
        assert got == brute_components(rows, 5, 80)
        assert asked[-1] < 200


def test_longer_bitmaps_keep_the_bound():
    rng = random.Random(2)
    for size in (1, 3, 40, 700, 20_000):
        sets = [J.shingle_hashes([f"w{rng.randrange(3 * size)}".encode() for _ in range(size)], 1) for _ in range(4)]
        apart = len(set(sets[0].tolist()) ^ set(sets[1].tolist()))
        for times in (1, J.FINE):
            a, b = J.bitmaps([J.bitmap(h, times) for h in sets])[:2]
            assert int(J.np.bitwise_count(a ^ b).sum()) <= apart
        long = J.bitmaps([J.bitmap(h, J.FINE) for h in sets], J.FINE)
        assert (long == J.bitmaps([J.bitmap(h) for h in sets])).all()


def test_hot_signatures_keep_every_member():
    import pyarrow as pa

    texts = pa.array([" ".join(f"w{k}" for k in range(60)) + f" end{i}" for i in range(300)])
    rows = [b for b in J._signed(3, 90, 8)([pa.RecordBatch.from_arrays([texts], names=["text"])])]
    plain = sum(b.num_rows for b in rows if b.column(0)[0].as_py() == -1)
    assert plain >= 300


def test_pigeonhole_bound():
    for percent in (50, 60, 80, 90):
        for s in range(1, 400):
            worst = max((s + t - 2 * o for t in range(s, 100 * s // percent + 1) for o in range(s + 1) if 100 * o >= percent * (s + t - o)), default=0)
            assert worst <= J.most_different(s, percent)


def signed_members(spark, texts, n, percent):
    """Members of all signatures that two sets and more have, as the join allocates them: sig -> (key, asks)."""
    sets = {k: J.shingle_hashes(J.words_of(t), n) for k, t in texts}
    sigs = {k: set(J.np.concatenate(J.signatures(h, percent)).view(J.np.int64).tolist()) for k, h in sets.items()}
    met = Counter(s for own in sigs.values() for s in own)
    rows = [(s, k, met[s], len(sets[k]), J.spare_of(len(sets[k]), percent), (J.tier(len(sets[k]))[0] & 1) * J.PARITY) for k, own in sigs.items() for s in own if met[s] > 1]
    shared = spark.createDataFrame(rows, "sig long, key long, n long, size long, spare int, parity int")
    out: dict = {}
    for r in J._asking(shared).collect():
        out.setdefault(r.sig, []).append((r.key, r.asks))
    return out


def test_no_group_of_unrelated_sets_asks(spark):
    """First segments of one shingle or none: a fixed share of unrelated sets meets there, but need not look there."""
    rng = random.Random(4)
    texts = [(k, " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(214, 300)))) for k in range(400)]
    members = signed_members(spark, texts, 5, 80)
    assert max(len(m) for m in members.values()) > 40  # they are all indexed there
    assert max((len(m) for m in members.values() if any(asks for _, asks in m)), default=0) < 40


def test_similar_sets_meet_where_one_asks(spark):
    """The pigeonhole holds for what is skipped: each similar pair shares a signature that its smaller set asks for."""
    rng = random.Random(6)
    texts = [(1000 + k, " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(60, 120)))) for k in range(300)]
    for g in range(100):
        base = [f"g{g}w{k}" for k in range(rng.randint(22, 130))]
        for v in range(3):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                own[rng.randrange(len(own))] = f"v{rng.randrange(10**6)}"
            texts.append((3 * g + v, " ".join(own)))
    sets = {k: J.shingles(J.words_of(t), 5) for k, t in texts}
    members = signed_members(spark, texts, 5, 80)
    met = {(a, b) for m in members.values() for a, asks in m if asks for b, _ in m}
    pairs = [(a, b) for g in range(100) for a in range(3 * g, 3 * g + 3) for b in range(3 * g, 3 * g + 3) if sets[a] != sets[b] and len(sets[a]) <= len(sets[b]) and J.similar(sets[a], sets[b], 80)]
    assert len(pairs) > 50
    assert met.issuperset(pairs)


def test_first_of_each(spark):
    rows = [(3, "a b c d e f g h"), (1, "a b c d e f g h"), (1, "a b c d e f g h"), (2, "x"), (None, "a b c d e f g h"), (5, None), (6, "")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    kept = J.first_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(map(repr, [1, 2, None, 5, 6]))
    assert J.first_of_each(docs.limit(0)).count() == 0


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 100)], "a long, b long")
    got = {r.node: r.label for r in graph.components(links).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}
    assert graph.components(links.limit(0)).count() == 0


def test_join_query(spark, sf):
    rows = collected(spark.read.parquet(f"{sf}/documents.parquet"))
    got = sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in queries.op8_ngram_jaccard(spark, sf).collect())
    assert got == brute_components(rows, 3, 90)
