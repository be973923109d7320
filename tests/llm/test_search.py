"""Searches against brute force, with odd vectors, ties and copies."""

import numpy as np

from quillsieve.llm import ann_search, queries, topk_search, vectors

from ..compare import duck, rows

SCHEMA = "vec_id long, embedding array<float>, cid long, v string"


def odd_vectors(spark, n=400, d=6):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, d)).round(1)
    table = [(k, [float(v) for v in x[k]], 1, "z") for k in range(n)]
    table += [(1000 + k, [float(v) for v in x[3]], 1, "z") for k in range(0, 80, 4)]  # copies, some of them queries
    table += [(2000, None, 1, "z"), (2020, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1, "z"), (2040, [float("nan")] * d, 1, "z"), (2060, [float("inf")] * d, 1, "z"), (2080, [0.0] * d, 1, "z"), (None, [1.0] * d, 1, "z"), (2100, [1.0, 2.0], 1, "z")]
    return spark.createDataFrame(table + [table[0], table[40]], SCHEMA)


def brute(df, make, keep_zero, k=20):
    table = {r.vec_id: r.embedding for r in df.collect() if r.vec_id is not None and r.embedding is not None and all(v is not None and np.isfinite(v) for v in r.embedding)}
    table = {i: make(v) for i, v in table.items() if keep_zero or any(v)}
    d = max(map(len, table.values()))
    x = {i: np.array([*v, *[0] * (d - len(v))]) for i, v in table.items()}
    out = {}
    for q in x:
        if q % 20 == 0:
            best = sorted((-(x[q] * x[i]).sum(), i) for i in x if i != q)[:k]
            out[q] = [(i, -s) for s, i in best]
    return out


def listed(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_topk_is_exact(spark):
    df = odd_vectors(spark)
    want = brute(df, lambda v: [int(np.floor(64.0 * c)) for c in v], True)
    for options in ({}, {"lists": 3, "block": 50, "query_block": 7}, {"lists": 1}):
        assert listed(topk_search.search(df, **options)) == want
    few = df.where("vec_id < 15")
    assert listed(topk_search.search(few)) == brute(few, lambda v: [int(np.floor(64.0 * c)) for c in v], True)
    assert topk_search.search(df.limit(0)).count() == 0


def test_topk_of_huge_components(spark):
    df = spark.createDataFrame([(k, [3.0e7 * (k + 1), 1.0]) for k in range(30)], "vec_id long, embedding array<float>")
    assert listed(topk_search.search(df, k=3)) == brute(df, lambda v: [int(np.floor(64.0 * c)) for c in v], True, 3)


def test_topk_query_equals_sql(spark, sf):
    assert rows(queries.op3_topk_search(spark, sf).toPandas()) == rows(duck(sf).sql(topk_search.ORACLE).df())


def test_ann_with_all_parts_is_exact(spark):
    df = odd_vectors(spark)
    want = brute(df, list, False)
    got = listed(ann_search.search(df, target_recall=1.0, part_rows=60))
    assert got.keys() == want.keys()
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hit >= 0.97 * sum(map(len, want.values()))
    for q, own in got.items():
        assert own == sorted(own, key=lambda x: (-x[1], x[0])) and all(i != q for i, _ in own)
    assert ann_search.search(df.limit(0)).count() == 0


def recall(got, want):
    return sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in want[q]}) for q in want) / sum(map(len, want.values()))


def test_registered_ann_recall(spark):
    """The query with its production parameters: several parts, not all of them probed, recall by brute force."""
    sf = "/root/testdata/sf0.1"
    want = brute(spark.read.parquet(f"{sf}/embeddings.parquet"), list, False)
    got = listed(queries.op6_ann_search(spark, sf))
    assert recall(got, want) >= 0.9
    exact = {q: dict(v) for q, v in want.items()}
    assert all(abs(exact[q][i] - s) < 1e-9 for q, v in got.items() for i, s in v if i in exact[q])


def test_ann_routes_again_within_large_parts(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(24, 12))
    x = np.vstack([c + 0.15 * rng.normal(size=(60, 12)) for c in centres])
    table = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = brute(table, list, False)
    got = listed(ann_search.search(table, sample=400, part_rows=40, least_parts=4, most_parts=8))
    assert recall(got, want) >= 0.9


def test_threshold_leaves_most_scores_alone(spark):
    own = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where("embedding IS NOT NULL").toPandas()
    x = np.floor(64 * np.stack([np.asarray(v, float) for v in own.embedding]))
    q = x[own.vec_id.to_numpy() % 20 == 0]
    totals, half, seen = q @ x.T, x.shape[1] // 2, topk_search.Resolved()
    cutoffs = np.sort(totals, 1)[:, -21]
    for k, (at, found) in enumerate(topk_search.candidates(q, x, [(0, half), (half, x.shape[1])], list(cutoffs), seen)):
        assert at.tolist() == np.flatnonzero(totals[k] >= cutoffs[k]).tolist() and found.tolist() == totals[k, at].tolist()
    assert seen.resolved <= seen.collected < 0.15 * totals.size


def test_parts_are_balanced_and_follow_clusters():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(4, 16))
    x = np.vstack([c + 0.1 * rng.normal(size=(100, 16)) for c in centres])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    part = ann_search.balanced_parts(ann_search.neighbour_graph(x, 8), 4)
    assert np.bincount(part).tolist() == [100] * 4
    assert np.mean([np.bincount(part[100 * k : 100 * k + 100], minlength=4).max() for k in range(4)]) > 95
    assert ann_search.learn(x, 4, 0.95, 10).probes <= 2


def test_vector_helpers():
    import pyarrow as pa

    assert vectors.matrix(pa.chunked_array([pa.array([[1, 2], [3]], pa.list_(pa.int64()))])).tolist() == [[1, 2], [3, 0]]
    assert vectors.best_rows(np.array([1.0, 3, 3, 2] * 30), np.arange(120), 2).tolist() == [1, 2]
