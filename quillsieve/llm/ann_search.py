"""Approximate nearest neighbours over learned partitions.

On a bounded sample: a neighbour graph, its balanced partitioning (recursive bisection by a smooth graph vector,
then swaps that lower the cut), and a small softmax classifier that learns the parts from the vectors. Every row is
indexed under its most probable part; a query is routed to its several most probable parts, whose rows are reranked
by the exact measure. Rows of the sample that the fit never saw say how many parts reach the wanted recall.

Tables of any size are partitioned. One router has at most 256 parts; where these hold too many rows each, every part
gets a router of its own, fitted on a bounded sample of its rows, and a query is routed again within each part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import vectors
from .common import partitions_for, written


@dataclass(frozen=True)
class Router:
    """A softmax classifier over unit vectors; ``probes`` parts are searched for each query."""

    weights: np.ndarray
    bias: np.ndarray
    probes: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Class scores; components beyond those learned are left out, missing ones are zeros."""
        d = self.weights.shape[0]
        x = x[:, :d] if x.shape[1] >= d else np.pad(x, ((0, 0), (0, d - x.shape[1])))
        size = np.sqrt((x * x).sum(1, keepdims=True))
        return x / np.where(size > 0, size, 1) @ self.weights + self.bias


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Per row, the positions of its k largest inner products with other rows."""
    out = np.empty((len(x), k), int)
    for start in range(0, len(x), 1024):
        s = x[start : start + 1024] @ x.T
        s[np.arange(len(s)), start + np.arange(len(s))] = -np.inf
        out[start : start + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(near: np.ndarray, parts: int, seed: int = 5) -> np.ndarray:
    """A part for each node, parts of equal size but for rounding; few edges between parts. ``parts``: a power of two."""
    n, k = near.shape
    a, b = np.repeat(np.arange(n), k), near.ravel()
    part, rng = np.zeros(n, int), np.random.default_rng(seed)
    count = 1
    while count < parts:
        for p in range(count):
            nodes = np.flatnonzero(part == p)
            if len(nodes) > 1:
                part[nodes] = p + count * _bisect(nodes, a, b, n, rng)
        count *= 2
    return part


def _bisect(nodes, a, b, n, rng) -> np.ndarray:
    """0 or 1 for each node: halves by the median of a smooth vector of the graph, then swaps."""
    place = np.full(n, -1)
    place[nodes] = np.arange(len(nodes))
    u, v = place[a], place[b]
    inside = (u >= 0) & (v >= 0)
    u, v = np.r_[u[inside], v[inside]], np.r_[v[inside], u[inside]]
    m = len(nodes)
    degree = np.maximum(np.bincount(u, minlength=m), 1)
    f = rng.standard_normal(m)
    for _ in range(60):
        f -= (f * degree).sum() / degree.sum()
        f = 0.5 * (f + np.bincount(u, f[v], minlength=m) / degree)
        f /= np.sqrt((f * f).mean()) or 1.0
    side = np.zeros(m, int)
    side[np.argsort(f, kind="stable")[m // 2 :]] = 1
    for _ in range(30):
        same = side[u] == side[v]
        gain = np.bincount(u, np.where(same, -1.0, 1.0), minlength=m)
        zeros, ones = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        zeros, ones = zeros[np.argsort(-gain[zeros], kind="stable")], ones[np.argsort(-gain[ones], kind="stable")]
        few = min(len(zeros), len(ones))
        good = np.flatnonzero(gain[zeros[:few]] + gain[ones[:few]] > 0)[: max(1, m // 50)]
        if not len(good):
            break
        side[zeros[good]], side[ones[good]] = 1, 0
    return side


def learn(sample: np.ndarray, parts: int, target: float, k: int, steps: int = 300, held: float = 0.2) -> Router:
    """Fit on the sample: graph, parts and classifier on some of its rows, probes that reach the wanted recall on the others.

    The held-out rows ask; their neighbours are sought among all rows of the sample.
    """
    d = sample.shape[1]
    asking = max(1, min(1000, int(len(sample) * held)))
    x = sample[asking:]
    unit = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-30)
    if parts < 2 or len(x) < 4 * parts:
        return Router(np.zeros((d, 1)), np.zeros(1), 1)
    part = balanced_parts(neighbour_graph(x, min(16, len(x) - 1)), parts)
    w, bias = np.zeros((d, parts)), np.zeros(parts)
    goal = np.eye(parts)[part]
    moment = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(bias), np.zeros_like(bias)]
    for step in range(1, steps + 1):
        z = unit @ w + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        for at, (value, slope) in enumerate(((w, unit.T @ (p - goal) / len(x) + 1e-4 * w), (bias, (p - goal).mean(0)))):
            first, second = moment[2 * at], moment[2 * at + 1]
            first += 0.1 * (slope - first)
            second += 0.01 * (slope * slope - second)
            value -= 0.2 * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    router = Router(w, bias, parts)
    z = router.scores(sample)
    home = z.argmax(1)
    asked = np.arange(asking)
    best = neighbour_graph_of(sample, asked, min(k, len(sample) - 1))
    order = np.argsort(-z[asked], axis=1)
    rank = np.argsort(order, axis=1)  # when a part is probed
    need = rank[np.arange(len(asked))[:, None], home[best]]
    recall = np.array([(need < p).mean() for p in range(1, parts + 1)])
    return Router(w, bias, int(np.argmax(recall >= min(target, recall[-1]))) + 1)


def neighbour_graph_of(x: np.ndarray, asked: np.ndarray, k: int) -> np.ndarray:
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -np.inf
    return np.argpartition(-s, k - 1, axis=1)[:, :k]


def search(rows: DataFrame, k: int = 20, divisor: int = 20, sample: int = 8192, target_recall: float = 0.95, part_rows: int = 2048, least_parts: int = 16, most_parts: int = 256, query_block: int = 2048) -> DataFrame:
    """``query_id long, rank int, vec_id long, score double`` of every row whose id ``divisor`` divides.

    ``sample`` bounds the rows that a router is fitted on; every row is indexed. A table has at least ``least_parts``
    parts, unless they would hold under four rows each. Vectors null, empty, all zero or
    with null or non-finite components take no part, nor do null ids. Rows repeated under an id count once (the
    smallest vector). Scores are inner products in double precision of the original vectors; ties go to the smaller id.
    """
    spark = rows.sparkSession
    vector = F.col("embedding")
    own = vectors.usable(rows, F.transform(vector, lambda x: x.cast("double") + F.lit(0.0)), vectors.finite(vector) & F.exists(vector, lambda x: x != 0))
    own = written(own)
    groups = written(vectors.classes(own, k))
    asked, queries = vectors.query_classes(own, groups, divisor)
    asked = written(asked)
    n_rows = groups.count()
    parts = 1
    while (parts * part_rows < n_rows or parts < least_parts) and parts < most_parts and 8 * parts <= min(n_rows, sample):
        parts *= 2
    drawn = groups.select("cid", "v").orderBy(F.xxhash64("cid", F.lit(3)), "cid").limit(sample).select("v").toArrow()
    router = learn(vectors.matrix(drawn.column("v")), parts, target_recall, k)
    shared = spark.sparkContext.broadcast({None: router})  # as large as dimensions times parts

    kind = "cid long, v array<double>, part int, turn int"
    routed = written(groups.select("cid", "v").mapInArrow(_route(shared, False), kind))
    asking = written(queries.mapInArrow(_route(shared, True), kind))
    if parts * part_rows < n_rows:
        below = _routers(routed, parts, n_rows, part_rows, most_parts, sample, target_recall, k)
        again = spark.sparkContext.broadcast(below)  # at most most_parts routers
        routed = written(routed.mapInArrow(_route_again(again, most_parts, False), kind))
        asking = written(asking.mapInArrow(_route_again(again, most_parts, True), kind))
    sizes = {r.part: r.n for r in routed.groupBy("part").agg(F.count("*").alias("n")).collect()}
    counts = {r.part: r.n for r in asking.groupBy("part").agg(F.count("*").alias("n")).collect()}
    shape = [(p, vectors.blocks_for(n, 2 * part_rows), vectors.blocks_for(counts.get(p, 0), query_block)) for p, n in sizes.items()]  # a row a part

    def grid() -> DataFrame:  # one row a part
        return F.broadcast(spark.createDataFrame(shape or [(0, 1, 1)], "part int, across int, down int"))

    right = routed.join(grid(), "part").withColumn("a", vectors.block_of(F.col("cid"), F.col("across"))).withColumn("d", F.explode(F.sequence(F.lit(0), F.col("down") - 1)))
    n = min(max(1, sum(a * d for _, a, d in shape)), 4 * partitions_for(spark))
    keys = ["part", "a", "d"]

    def rerank(some: DataFrame) -> DataFrame:
        left = some.join(grid(), "part").withColumn("d", vectors.block_of(F.col("cid"), F.col("down"))).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("across") - 1)))
        return left.repartition(n, *keys).groupBy(*keys).cogroup(right.repartition(n, *keys).groupBy(*keys)).applyInArrow(_rerank(k + 1), "qid long, cid long, score double")

    # the most probable part first: what it gives bounds what the other parts need to list
    first = written(rerank(asking.where("turn = 0").withColumn("low", F.lit(None).cast("double"))))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score")))
    lows = first.withColumn("r", rank).where(F.col("r") == k + 1).select(F.col("qid").alias("cid"), F.col("score").alias("low"))
    found = first.union(rerank(asking.where("turn > 0").join(lows, "cid", "left")))
    return vectors.ranked(found, groups, asked, k, "double")


def _batch(batch: pa.RecordBatch, at: np.ndarray, part: np.ndarray, turn: np.ndarray) -> pa.RecordBatch:
    taken = batch.take(pa.array(at))
    return pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array(part.astype(np.int32)), pa.array(turn.astype(np.int32))], names=["cid", "v", "part", "turn"])


def _route(shared, ask: bool):
    def run(batches):
        router = shared.value[None]
        for batch in batches:
            if batch.num_rows:
                z = router.scores(vectors.matrix(batch.column(1)))
                best = np.argsort(-z, axis=1, kind="stable")[:, : router.probes if ask else 1]
                yield _batch(batch, np.repeat(np.arange(len(z)), best.shape[1]), best.ravel(), np.tile(np.arange(best.shape[1]), len(z)))

    return run


def _route_again(shared, most_parts: int, ask: bool):
    """Within each part that has a router of its own: part ``p`` becomes ``p * most_parts`` and up."""

    def run(batches):
        for batch in batches:
            part, turn = np.asarray(batch.column(2)), np.asarray(batch.column(3))
            for p in np.unique(part).tolist():
                at = np.flatnonzero(part == p)
                router = shared.value.get(p)
                if router is None:
                    yield _batch(batch, at, part[at] * most_parts, turn[at])
                    continue
                z = router.scores(vectors.matrix(batch.take(pa.array(at)).column(1)))
                best = np.argsort(-z, axis=1, kind="stable")[:, : router.probes if ask else 1]
                rank = turn[at][:, None] * most_parts + np.arange(best.shape[1])
                yield _batch(batch, np.repeat(at, best.shape[1]), part[at[0]] * most_parts + best.ravel(), rank.ravel())

    return run


def _routers(routed: DataFrame, parts: int, n_rows: int, part_rows: int, most_parts: int, sample: int, target: float, k: int) -> dict:
    """A router for each part of more than ``part_rows`` rows, fitted in a task of its own on a bounded draw of its rows."""
    sizes = {r.part: r.n for r in routed.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row a part
    first = Window.partitionBy("part").orderBy(F.xxhash64("cid", F.lit(5)), "cid")
    drawn = routed.withColumn("r", F.row_number().over(first)).where(F.col("r") <= sample).select("part", "v")  # the limit also runs before the shuffle

    def fit(table: pa.Table) -> pa.Table:
        p = table.column("part")[0].as_py()
        own = 1
        while own * part_rows < sizes[p] and own < most_parts and 8 * own <= len(table):
            own *= 2
        router = learn(vectors.matrix(table.column("v")), own, target, k)
        return pa.table({"part": pa.array([p], pa.int32()), "width": pa.array([router.weights.shape[0]], pa.int32()), "weights": [router.weights.ravel().tolist()], "bias": [router.bias.tolist()], "probes": pa.array([router.probes], pa.int32())})

    made = drawn.groupBy("part").applyInArrow(fit, "part int, width int, weights array<double>, bias array<double>, probes int").collect()  # at most most_parts routers
    return {r.part: Router(np.array(r.weights).reshape(r.width, -1), np.array(r.bias), r.probes) for r in made if len(r.bias) > 1}


def _rerank(most: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], []]
        if len(left) and len(right):
            q, x = vectors.same_width(vectors.matrix(left.column("v")), vectors.matrix(right.column("v")))
            qid, cid, lows = np.asarray(left.column("cid")), np.asarray(right.column("cid")), left.column("low").to_pylist()
            for start in range(0, len(q), 256):
                rough = q[start : start + 256] @ x.T
                for k, s in enumerate(rough):
                    slack = 1e-9 * max(1.0, np.abs(s).max())  # the product of matrices may round another way
                    cut = np.partition(s, len(s) - most)[len(s) - most] - slack if len(s) > most else -np.inf
                    low = lows[start + k]
                    at = np.flatnonzero(s >= (cut if low is None else max(cut, low - slack)))
                    exact = (q[start + k] * x[at]).sum(1)
                    best = vectors.best_rows(exact, cid[at], most)
                    out[0].append(np.full(len(best), qid[start + k]))
                    out[1].append(cid[at[best]])
                    out[2].append(exact[best])
        kinds = (np.int64, np.int64, np.float64)
        return pa.table({n: np.concatenate(v).astype(t) if v else pa.array([], pa.from_numpy_dtype(t)) for n, v, t in zip(("qid", "cid", "score"), out, kinds)})

    return run
