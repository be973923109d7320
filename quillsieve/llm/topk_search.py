"""Exact top-k search by a three-phase uniform threshold.

The components of a vector are dealt to ``lists`` score lists; a score is the sum of its entries in all of them.
Phase 1 gathers the best local entries of each list in one block of rows, a small part of all, resolves these and
takes the (k+1)-th best total as a cutoff that the answer cannot fall below. Phase 2 sends the cutoff with the queries:
a total of at least the cutoff has an entry of at least cutoff / lists in some list, so each list collects only those.
Phase 3 resolves the scores that such a candidate lacks in the other lists, and keeps what reaches the cutoff.

A list scores its own components only. It is ordered by the length of its rows' parts, and a part of length l scores at
most l times that of the query: the list ends where that falls below cutoff / lists.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import vectors
from .common import partitions_for, written


def quantised(vector: Column) -> Column:
    """floor(64 * x) of every component, x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(64.0) * x.cast("double")).cast("long"))


def search(rows: DataFrame, k: int = 20, divisor: int = 20, lists: int = 2, block: int = 4096, query_block: int = 2048, first_part: int = 16) -> DataFrame:
    """``query_id long, rank int, vec_id long, score long`` of every row whose id ``divisor`` divides.

    Vectors null or with null or non-finite components take no part, nor do null ids; an empty vector is all zeros, a
    shorter one is continued by zeros. Rows repeated under an id count once (the smallest vector). Ties go to the
    smaller id. Scores are exact as long as they fit 64 bits. Every query class meets every class, in blocks; phase 1
    reads one of at least ``first_part`` blocks, if such a block holds k + 1 rows well enough.
    """
    spark = rows.sparkSession
    own = vectors.usable(rows, quantised(F.col("embedding")), vectors.finite(F.col("embedding")))
    own = written(own)
    groups = written(vectors.classes(own, k))
    asked, queries = vectors.query_classes(own, groups, divisor)
    queries, asked = written(queries), written(asked)
    n_rows, n_queries = groups.count(), queries.count()
    across, down = vectors.blocks_for(n_rows, block), vectors.blocks_for(n_queries, query_block)

    def paired(q: DataFrame, blocks: int, only_own: bool):
        mine = vectors.block_of(F.col("cid"), blocks)
        with_ = mine if only_own else F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        left = q.withColumn("d", vectors.block_of(F.col("cid"), down)).withColumn("a", with_)
        right = groups.select("cid", "v", mine.alias("a")).withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
        n = min(blocks * down, 4 * partitions_for(spark))
        return left.repartition(n, "a", "d").groupBy("a", "d").cogroup(right.repartition(n, "a", "d").groupBy("a", "d"))

    few = max(1, min(max(across, first_part), n_rows // (2 * (k + 1))))  # each block is sure to hold rows enough, or gives no cutoff
    first = paired(queries, few, True).applyInArrow(_gather(k + 1, lists), "qid long, score long")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score")))
    cutoffs = first.withColumn("r", rank).where(F.col("r") <= k + 1).groupBy("qid").agg(F.min("score").alias("low"), F.count("*").alias("n"))
    bounded = queries.join(cutoffs, queries.cid == cutoffs.qid, "left").select("cid", "v", F.when(F.col("n") > k, F.col("low")).alias("cutoff"))
    found = paired(bounded, across, False).applyInArrow(_collect(k + 1, lists), "qid long, cid long, score long")
    return vectors.ranked(found, groups, asked, k, "long")


def _exact(q: np.ndarray, x: np.ndarray) -> bool:
    """True if doubles hold every partial sum of the products."""
    return q.shape[1] * np.abs(q).max(initial=0) * np.abs(x).max(initial=0) < 2**53


def _loaded(left: pa.Table, right: pa.Table, lists: int):
    q, x = vectors.same_width(vectors.matrix(left.column("v")), vectors.matrix(right.column("v")))
    if not _exact(q, x):
        q, x = q.astype(np.int64), x.astype(np.int64)
    cuts = np.linspace(0, q.shape[1], lists + 1).astype(int)
    return q, x, list(zip(cuts, cuts[1:])), np.asarray(left.column("cid")), np.asarray(right.column("cid"))


def _gather(most: int, lists: int):
    """Phase 1: the local lists' best entries of a block, resolved; the best totals of each query."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out_q, out_s = [], []
        if len(left) and len(right):
            q, x, parts, qid, _ = _loaded(left, right, lists)
            few = min(most, len(x))
            for start in range(0, len(q), 256):
                block = q[start : start + 256]
                at = np.hstack([np.argpartition(-(block[:, a:b] @ x[:, a:b].T), few - 1, axis=1)[:, :few] for a, b in parts])
                at.sort(axis=1)
                totals = np.einsum("qd,qcd->qc", block, x[at])
                lowest = np.iinfo(np.int64).min if totals.dtype == np.int64 else -np.inf
                totals[:, 1:][at[:, 1:] == at[:, :-1]] = lowest  # an entry of several lists counts once
                totals = -np.sort(-totals, axis=1)[:, :few]
                out_q.append(np.repeat(qid[start : start + 256], few))
                out_s.append(totals.ravel())
        if not out_q:
            return pa.table({"qid": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        return pa.table({"qid": np.concatenate(out_q).astype(np.int64), "score": np.concatenate(out_s).astype(np.int64)})

    return run


@dataclass
class Resolved:
    """Scores that the phases looked at: list entries scored, entries collected, entries that phase 3 resolved."""

    scored: int = 0
    collected: int = 0
    resolved: int = 0


def candidates(q: np.ndarray, x: np.ndarray, parts: list, cutoffs: list, seen: Resolved | None = None):
    """For each query: rows whose total reaches its cutoff, and these totals. A cutoff of None: all rows.

    ``parts`` are the lists' ranges of components.
    """
    n, m = len(x), len(parts)
    lists = []
    for a, b in parts:
        length = np.sqrt((x[:, a:b].astype(float) ** 2).sum(1))
        order = np.argsort(-length, kind="stable")
        lists.append((order, length[order], x[order, a:b], np.sqrt((q[:, a:b].astype(float) ** 2).sum(1))))
    for start in range(0, len(q), 256):
        block = q[start : start + 256]
        limits = cutoffs[start : start + 256]
        share = np.array([-np.inf if c is None else c / m for c in limits])
        found = [[] for _ in block]
        for k, (order, length, rows, own) in enumerate(lists):
            # the longest prefix that any query of the block needs
            need = [n if s <= 0 else int(np.searchsorted(-length, -(s / (o or 1e-300)) * (1 - 1e-9), side="right")) for s, o in zip(share, own[start : start + 256])]
            end = max(need, default=0)
            a, b = parts[k]
            local = block[:, a:b] @ rows[:end].T
            for j in range(len(block)):
                at = np.flatnonzero(local[j, : need[j]] * m >= (limits[j] if limits[j] is not None else -np.inf))
                found[j].append((order[at], local[j, at]))
                if seen:
                    seen.scored += need[j]
                    seen.collected += len(at)
        for j, query in enumerate(block):
            rows = np.unique(np.concatenate([at for at, _ in found[j]]))
            totals = np.zeros(len(rows), x.dtype)
            for (a, b), (at, scores) in zip(parts, found[j]):
                place = np.searchsorted(rows, at)
                totals[place] += scores
                lacks = np.ones(len(rows), bool)
                lacks[place] = False
                totals[lacks] += x[rows[lacks], a:b] @ query[a:b]
                if seen:
                    seen.resolved += int(lacks.sum())
            enough = np.ones(len(rows), bool) if limits[j] is None else totals >= limits[j]
            yield rows[enough], totals[enough]


def _collect(most: int, lists: int):
    """Phases 2 and 3: entries over the uniform threshold, resolved and held against the cutoff."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], []]
        if len(left) and len(right):
            q, x, parts, qid, cid = _loaded(left, right, lists)
            for own, (at, totals) in zip(qid, candidates(q, x, parts, left.column("cutoff").to_pylist())):
                best = vectors.best_rows(totals, cid[at], most)
                out[0].append(np.full(len(best), own))
                out[1].append(cid[at[best]])
                out[2].append(totals[best])
        names = ("qid", "cid", "score")
        return pa.table({n: np.concatenate(v).astype(np.int64) if v else pa.array([], pa.int64()) for n, v in zip(names, out)})

    return run


#: DuckDB SQL of the registered query: every pair is scored.
ORACLE = """
WITH own AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(x.v AS DOUBLE[])) AS BIGINT) AS score
  FROM own q JOIN own x ON q.vec_id % 20 = 0 AND q.vec_id <> x.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 20"""
