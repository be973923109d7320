"""Mixing sources to target weights by iterative proportional fitting.

Token totals by source, language and topic form a table of cells. Raking scales the cells to each target marginal in
turn until all hold. A cell's weight (raked over own tokens) times one common factor, at most 1, is the probability
of each of its documents; the factor makes the expected tokens a given share of all. What the limit of 1 cuts off
stays as a sampling weight over 1, so weighted totals still meet the targets.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text, written

NONE = "(none)"
AXES = ("source", "lang", "topic")
#: A table of more cells than these levels make stays distributed; else it is raked on the driver. Every level has its
#: own target either way, and the weights are the same.
MOST_LEVELS = {"source": 500, "lang": 50, "topic": 16}
#: Targets are the own shares to these powers: 1 leaves an axis as it is, 0 makes its levels equal.
POWERS = {"source": 0.7, "lang": 0.8, "topic": 0.7}


def topic_of(text: Column, words: Column) -> Column:
    """A topic from a text's form, as ``documents`` names none: table, shout, note, article or book."""
    bars = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    upper = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return (
        F.when(bars * 8 > words, "table")
        .when(upper * 3 > F.length(text), "shout")
        .when(words < 100, "note")
        .when(words < 1000, "article")
        .otherwise("book")
    )


def with_axes(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_tokens`` (words) and the axes; null levels are NONE."""
    text = whole_text()
    words = F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
    out = docs.withColumn("n_tokens", words).withColumn("topic", topic_of(text, F.col("n_tokens")))
    return out.withColumns({a: F.coalesce(F.col(a).cast("string"), F.lit(NONE)) for a in ("source", "lang")})


def rake(totals: np.ndarray, levels: list[np.ndarray], targets: list[np.ndarray], rounds: int = 500, close: float = 1e-12) -> np.ndarray:
    """Weights of cells with ``totals``: ``levels[a][cell]`` is a cell's level on an axis, ``targets[a]`` its marginals."""
    raked = totals.astype(float).copy()
    for _ in range(rounds):
        most = 0.0
        for level, target in zip(levels, targets):
            now = np.bincount(level, raked, minlength=len(target))
            factor = np.where(now > 0, target / np.where(now > 0, now, 1), 1.0)
            raked *= factor[level]
            most = max(most, np.abs(factor[now > 0] - 1).max(initial=0))
        if most < close:
            break
    return np.divide(raked, totals, out=np.ones_like(raked), where=totals > 0)


def probabilities(totals: np.ndarray, weights: np.ndarray, keep: float) -> np.ndarray:
    """min(1, factor * weight) for each cell, with expected tokens of ``keep`` times all (as far as positive weights go)."""
    order = np.argsort(-weights, kind="stable")
    t, w = totals[order].astype(float), weights[order]
    whole = np.r_[0, np.cumsum(t)]  # the first cells at probability 1
    rest = np.r_[np.cumsum((t * w)[::-1])[::-1], 0]
    goal = keep * t.sum()
    for k in range(len(t)):
        if rest[k] <= 0:  # all that has a weight is at 1
            return (weights > 0).astype(float)
        factor = (goal - whole[k]) / rest[k]
        if factor * w[k] <= 1:
            return np.minimum(1, factor * weights)
    return np.ones(len(t))


def cells(docs: DataFrame) -> DataFrame:
    """Token totals of every cell."""
    return written(with_axes(docs).groupBy(*AXES).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")))


def calibrate(docs: DataFrame, keep: float = 0.5, targets: dict | None = None) -> DataFrame:
    """A row for each cell: the axes, ``weight`` and ``probability``.

    ``targets`` gives shares by level for an axis; axes and levels without one follow POWERS.
    """
    spark = docs.sparkSession
    sums = cells(docs)
    if sums.count() > math.prod(MOST_LEVELS.values()):
        return _calibrate_far(sums, keep, targets)
    table = sums.orderBy(*AXES).collect()  # bounded by MOST_LEVELS
    totals = np.array([r.tokens for r in table], float)
    levels, wanted = [], []
    for a in AXES:
        names, level = np.unique([r[a] for r in table], return_inverse=True) if table else (np.array([]), np.zeros(0, int))
        own = np.bincount(level, totals, minlength=len(names))
        share = np.where(own > 0, own, 0) ** POWERS[a]
        if share.sum():
            share = share / share.sum()
        for k, name in enumerate(names):
            share[k] = (targets or {}).get(a, {}).get(str(name), share[k])
        levels.append(level)
        wanted.append(totals.sum() * share / share.sum() if share.sum() else share)
    weights = rake(totals, levels, wanted) if table else totals
    chance = probabilities(totals, weights, keep) if table else totals
    rows = [(*(r[a] for a in AXES), float(w), float(p)) for r, w, p in zip(table, weights, chance)]
    return F.broadcast(spark.createDataFrame(rows, ", ".join(f"{a} string" for a in AXES) + ", weight double, probability double"))


def _targets_far(sums: DataFrame, a: str, targets: dict | None, total: float) -> DataFrame:
    """Each level of an axis with its marginal ``target`` and the factor ``f_<axis>`` to begin with."""
    power = F.pow(F.col("own"), F.lit(float(POWERS[a])))
    table = sums.groupBy(a).agg(F.sum("tokens").cast("double").alias("own"))
    whole = table.agg(F.sum(power)).first()[0] or 1.0
    table = table.withColumn("share", power / F.lit(whole))
    if given := (targets or {}).get(a):
        given = table.sparkSession.createDataFrame([(str(k), float(v)) for k, v in given.items()], f"{a} string, given double")
        table = table.join(given, a, "left").withColumn("share", F.coalesce("given", "share"))
    table = written(table.select(a, "share"))
    shares = table.agg(F.sum("share")).first()[0] or 1.0
    return written(table.select(a, (F.lit(total) * F.col("share") / F.lit(shares)).alias("target"), F.lit(1.0).alias(f"f_{a}")))


def _calibrate_far(sums: DataFrame, keep: float, targets: dict | None, rounds: int = 500, close: float = 1e-12) -> DataFrame:
    """:func:`rake` and :func:`probabilities` without the cell table on the driver. A cell's weight is the product of its
    levels' factors, so a step is a sum of the cells by an axis, and only that axis' factors are written again."""
    total = float(sums.agg(F.sum("tokens")).first()[0] or 0)
    factors = {a: _targets_far(sums, a, targets, total) for a in AXES}

    def weighted(axes):
        out, product = sums, F.col("tokens").cast("double")
        for a in axes:
            out, product = out.join(factors[a].select(a, f"f_{a}"), a), product * F.col(f"f_{a}")
        return out.withColumn("raked", product)

    for _ in range(rounds):
        most = 0.0
        for a in AXES:
            now = weighted([x for x in AXES if x != a]).groupBy(a).agg(F.sum("raked").alias("rest"))
            met = F.col(f"f_{a}") * F.col("rest")
            step = F.when(met > 0, F.col("target") / met).otherwise(F.lit(1.0))
            new = written(factors[a].join(now, a).select(a, "target", (F.col(f"f_{a}") * step).alias(f"f_{a}"), F.when(met > 0, F.abs(step - 1)).alias("moved")))
            most = max(most, new.agg(F.max("moved")).first()[0] or 0.0)
            factors[a] = new.drop("moved")
        if most < close:
            break
    weight = F.when(F.col("tokens") > 0, F.col("raked") / F.col("tokens")).otherwise(F.lit(1.0))
    table = written(weighted(AXES).select(*AXES, "tokens", weight.alias("weight")))
    # cells at probability 1 grow in number until the factor over the rest takes no more of them over 1
    factor, before = 0.0, -1
    while True:
        at_one = (F.col("weight") * F.lit(factor)) > 1
        r = table.agg(
            F.sum(F.when(at_one, 1).otherwise(0)).alias("n"),
            F.sum(F.when(at_one, F.col("tokens")).otherwise(0)).cast("double").alias("whole"),
            F.sum(F.when(~at_one, F.col("tokens") * F.col("weight")).otherwise(0.0)).alias("rest"),
        ).first()
        if r.n is None or r.n == before:
            chance = F.least(F.lit(1.0), F.col("weight") * F.lit(factor))
            break
        if r.rest <= 0:  # all that has a weight is at 1
            chance = (F.col("weight") > 0).cast("double")
            break
        before, factor = r.n, max(factor, (keep * total - r.whole) / r.rest)
    return table.select(*AXES, "weight", chance.alias("probability"))


def draw(docs: DataFrame, seed: str = "mix") -> Column:
    """A number from 0 to 1 that the id and the seed give: 52 bits of an MD5."""
    said = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(docs["doc_id"].cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(said, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def sample(docs: DataFrame, keep: float = 0.5, targets: dict | None = None, seed: str = "mix") -> DataFrame:
    """Every row: its id, axes, ``n_tokens``, ``weight`` (raked), ``probability``, ``sampled`` and ``sample_weight``.

    ``sample_weight`` is what a sampled row counts for (weight over probability). Null texts have no tokens; rows
    without tokens in a cell without tokens have weight 1. Null sources and languages are a level of their own; a null
    id draws as the empty text; repeated rows draw alike. An empty table gives no rows.
    """
    plan = calibrate(docs, keep, targets)
    named = with_axes(docs.select("doc_id", "text", "source", "lang")).withColumn("u", draw(docs, seed)).drop("text")
    out = named.join(plan, list(AXES), "left")
    chance = F.col("probability")
    return out.select("doc_id", *AXES, "n_tokens", "weight", "probability", (F.col("u") < chance).alias("sampled"), F.when(chance > 0, F.col("weight") / chance).alias("sample_weight"))


def sampled_rows(docs: DataFrame, keep: float = 0.5, targets: dict | None = None, seed: str = "mix") -> DataFrame:
    """The rows of ``docs`` that are drawn, as they are. Rows of cells that fell to probability 0 go."""
    plan = calibrate(docs, keep, targets)
    named = docs.select(F.struct(*docs.columns).alias("__row"), "doc_id", "text", "source", "lang")
    named = with_axes(named).withColumn("__u", draw(named, seed))
    out = named.join(plan, list(AXES), "left").where(F.col("__u") < F.col("probability"))
    return out.select("__row.*")
