"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance that is shrunk towards the pooled diagonal. A score is the difference of the
two log densities (Mahalanobis distances by cached Cholesky factors, plus log determinants and log priors) through
the logistic function. Training needs only sums, sums of products and counts, added up over all labelled rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Byte classes of which a text's share is a feature.
GROUPS = {
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "digit": bytes(range(48, 58)),
    "space": b" \t",
    "line": b"\n",
    "stop": b".",
    "comma": b",;:",
    "bang": b"!?",
    "symbol": b"#$%&*+=@^~`\\",
    "bar": b"|<>{}[]/_",
    "quote": b"\"'()-",
    "other": bytes(range(128, 256)),
}
NAMES = [*GROUPS, "log_bytes", "word_length", "word_spread", "distinct_words", "distinct_lines", "capital_words", "entropy"]
_MEMBER = np.array([[b in g for b in range(256)] for g in GROUPS.values()], float)


def statistics(texts: list[str]) -> np.ndarray:
    """One row of transformed statistics a text: square roots of shares, logarithms of sizes. Empty texts: zeros."""
    out = np.zeros((len(texts), len(NAMES)))
    counts = np.zeros((len(texts), 256))
    for k, text in enumerate(texts):
        data = text.encode()
        if not data:
            continue
        counts[k] = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        words, lines = data.split(), data.split(b"\n")
        sizes = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
        out[k, len(GROUPS) :] = (
            np.log1p(len(data)),
            np.log1p(sizes.mean()),
            np.log1p(sizes.std()),
            np.sqrt(len(set(words)) / max(1, len(words))),
            np.sqrt(len(set(lines)) / len(lines)),
            np.sqrt(sum(w[:1].isupper() for w in words) / max(1, len(words))),
            0.0,
        )
    total = counts.sum(1, keepdims=True)
    share = counts / np.maximum(total, 1)
    out[:, : len(GROUPS)] = np.sqrt(share @ _MEMBER.T)
    out[:, -1] = -(share * np.log(np.where(share > 0, share, 1))).sum(1)
    return out


@dataclass(frozen=True)
class Model:
    """By class: log prior, mean, inverse Cholesky factor, log determinant. None: the class had no rows."""

    classes: tuple

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1. Without rows of a class: the other's; without any: 0.5."""
        if None in self.classes:
            known = [k for k, c in enumerate(self.classes) if c is not None]
            return np.full(len(x), float(known[0]) if known else 0.5)
        low, high = ([p - 0.5 * (((x - m) @ w.T) ** 2).sum(1) - 0.5 * d for p, m, w, d in self.classes])
        return 1 / (1 + np.exp(-np.clip(high - low, -500, 500)))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that training never sees: crc32 of the id as text leaves 1 modulo 3."""
    return common.id_remainder(id_col, 3) == 1


def fit(docs: DataFrame, labels: DataFrame, shrinkage: float = 0.1) -> Model:
    """Learn from every labelled row that is not held out; labels other than 0 and 1, null ids and rows without a text row take no part.

    Texts become short statistic rows before they meet their labels, each task adds up its own sums, and the driver
    gets two small matrices. Repeated rows count as often as they occur.
    """
    rows = docs.where(~held_out() & F.col("doc_id").isNotNull())
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out()).select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("y"))
    narrow = rows.select(F.col("doc_id").cast("long").alias("id"), common.whole_text().alias("text"))
    stats = narrow.mapInArrow(_statistics, "id long, x array<double>")
    sums = stats.join(known, "id").select("y", "x").mapInArrow(_sums, "y int, cell int, v double").groupBy("y", "cell").agg(F.sum("v").alias("v")).collect()
    d, found = len(NAMES), {0: {}, 1: {}}
    for r in sums:
        found[r.y][r.cell] = r.v
    parts = []
    for y in (0, 1):
        flat = np.array([found[y].get(k, 0.0) for k in range(1 + d + d * d)])
        parts.append((flat[0], flat[1 : 1 + d], flat[1 + d :].reshape(d, d)))
    return _model(parts, shrinkage)


def _model(parts: list, shrinkage: float) -> Model:
    total = sum(n for n, _, _ in parts)
    if not total:
        return Model((None, None))
    scatter = [q - np.outer(s, s) / n if n else np.zeros_like(q) for n, s, q in parts]
    pooled = np.diag(np.maximum(np.diag(sum(scatter)) / total, 1e-6))
    classes = []
    for (n, s, _), within in zip(parts, scatter):
        if not n:
            classes.append(None)
            continue
        weight = max(shrinkage, len(pooled) / (n + len(pooled)))  # few rows: closer to the pooled diagonal
        lower = np.linalg.cholesky((1 - weight) * within / n + weight * pooled + 1e-6 * np.eye(len(pooled)))
        classes.append((np.log(n / total), s / n, np.linalg.inv(lower), 2 * np.log(np.diag(lower)).sum()))
    return Model(tuple(classes))


def _statistics(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            part = batch.slice(start, 1000)
            x = statistics(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "x"])


def _sums(batches):
    d = len(NAMES)
    total = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        y = np.asarray(batch.column(0))
        x = batch.column(1).flatten().to_numpy().reshape(-1, d)
        for k in (0, 1):
            own = x[y == k]
            total[k] += np.r_[len(own), own.sum(0), (own.T @ own).ravel()]
    for k in (0, 1):
        if total[k, 0]:
            n = total.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array([k] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(total[k])], names=["y", "cell", "v"])


def score(docs: DataFrame, model: Model, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with a double score and an int prediction added, under ``names`` (replacing columns of these names).

    Scores depend on the text alone. Null and empty texts get the score of all-zero statistics. Repeated rows stay.
    """
    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

    rest = docs.drop(*names)
    schema = StructType([*rest.schema.fields, StructField(names[0], DoubleType()), StructField(names[1], IntegerType())])
    at = rest.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two matrices of fixed size

    def run(batches):
        own = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                s = own.score(statistics([t or "" for t in part.column(at).to_pylist()]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=schema.names)

    return rest.mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model takes for class 1, all their columns as they are."""
    free = common.free_names(docs.columns, "score", "predicted")
    return score(docs, model, (free["score"], free["predicted"])).where(F.col(free["predicted"]) == 1).select(*docs.columns)
