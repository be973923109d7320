"""LM scoring: a hashed maximum-entropy model with a class-factored softmax.

A token's probability is P(class | classes before) times P(token | class, words before). The first factor is a softmax
over classes whose hashed features are the class before (2-gram), the class two before (skip) and both (3-gram); it is
trained by distributed gradient updates over all training tokens, and scored in sparse numpy batches of distinct contexts.

The second is a softmax over the training tokens of the class and one event for unknown tokens, laid out as a binary
tree. Each decision on a token's path has as features the word before (2-gram), the word two before (skip) and both
(3-gram), hashed together with the decision into a table of weights. All decisions start at the add-one counts, and the
weights are trained over all training tokens of the class. Classes are independent there, so each token travels to its
class's task, with the hashes of the words before; tables and tokens grow with the input, and with them the buckets that
a class is cut into by word. Counts are found there too; what returns are sums by document.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SHORT, ENDINGS = 96, 31  # classes of short tokens and of endings
CLASSES = SHORT + ENDINGS + 1
END_CLASS = CLASSES - 1  # has the end token alone
END = b""  # no word is empty
FEATURES = 1 << 14
BUCKET_BYTES = 2_000_000_000  # of all texts, for each bucket of a class; a task holds a bucket's tokens, some 20 bytes each
MOST_WEIGHTS = 1 << 22  # of a bucket

_DOCS, _TOKENS, _GRAMS, _SUMS, _TOTALS, _ENDS = range(6)
_PACKED = "route long, kind int, chunk long, blob binary, code int, n long"


def token_class(word: bytes) -> int:
    """A class that the token alone gives: short ones by themselves, longer ones by their last two bytes."""
    if not word:
        return END_CLASS
    return zlib.crc32(word) % SHORT if len(word) <= 4 else SHORT + zlib.crc32(word[-2:]) % ENDINGS


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that training never sees: crc32 of the id as text leaves 2 modulo 7."""
    return common.id_remainder(id_col, 7) == 2


def tokens(text: str) -> list[bytes]:
    """A-Z in lower case; runs of bytes other than space and U+0009-U+000D."""
    return text.encode().lower().split()


def two_before(values: np.ndarray, starts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The values one and two before each token; before a text's first token stand two ends."""
    one = np.r_[values[:0], np.array([end], values.dtype), values[:-1]]
    two = np.r_[np.array([end], values.dtype), one[:-1]]
    one[starts] = end
    two[starts] = end
    after = starts + 1
    two[after[after < len(two)]] = end
    return one, two


def contexts(classes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Code of the two classes before each token; before a text's first token stand two ends."""
    one, two = two_before(classes, starts, END_CLASS)
    return two * CLASSES + one


def features(context: np.ndarray) -> np.ndarray:
    """Hashed features of contexts: 2-gram, skip, 3-gram; three columns under ``FEATURES``."""
    two, one = np.divmod(context.astype(np.uint64), np.uint64(CLASSES))
    keys = np.stack([one * np.uint64(3), two * np.uint64(3) + np.uint64(1), (two * np.uint64(CLASSES) + one) * np.uint64(3) + np.uint64(2)], axis=1)
    keys = (keys + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return ((keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % FEATURES


def log_probabilities(weights: np.ndarray, bias: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Natural log of P(class | context), a row for each context."""
    z = weights[features(context)].sum(1) + bias
    z -= z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; bytes of a kind stand together where that helps (:func:`unpack`)."""
    head = np.array([len(arrays), *(x for v in arrays for x in (len(v), v.dtype.num))], np.int64)
    body = b"".join([head.tobytes(), *(v.view(np.uint8).reshape(len(v), -1).T.tobytes() if v.dtype == np.int32 else v.tobytes() for v in arrays)])
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    body = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    count = int(np.frombuffer(body, np.int64, 1)[0])
    head, at, out = np.frombuffer(body, np.int64, 2 * count, 8).reshape(-1, 2), 8 + 16 * count, []
    for size, num in head.tolist():
        kind = _KINDS[num]
        raw = np.frombuffer(body, np.uint8, size * kind.itemsize, at)
        out.append(np.ascontiguousarray(raw.reshape(4, size).T).view(np.int32).ravel() if kind == np.int32 else raw.view(kind) if at % kind.itemsize == 0 else raw.copy().view(kind))
        at += len(raw)
    return out


_KINDS = {np.dtype(t).num: np.dtype(t) for t in (np.int32, np.int64, np.uint8, np.uint32, np.float32, np.float64)}


def chunks(docs: DataFrame, chunk_bytes: int = 8_000_000, buckets: int = 1) -> DataFrame:
    """Packed rows by route: a chunk's documents with the classes of their tokens; for each class (and bucket) its words
    and tokens, with hashes of the two words before each; training counts of class 3-grams; training documents."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), common.whole_text().alias("text"))
    return narrow.mapInArrow(_chunks(chunk_bytes, buckets), _PACKED)


def _row(schema: str, **columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds[t]) if c in columns else pa.nulls(size, kinds[t]) for c, t in fields], names=[c for c, _ in fields])


def _chunks(chunk_bytes: int, buckets: int):
    def finish(chunk, numbers, docs) -> Iterator[pa.RecordBatch]:
        words = list(numbers)
        classes = np.fromiter(map(token_class, words), np.int64, len(words))
        hashes = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        routes = classes + CLASSES * ((hashes >> np.uint32(7)).astype(np.int64) * 0x9E3779B1 % 2**32 * buckets >> 32)
        sizes = np.array([len(i) + 1 for _, _, i in docs], np.int64)
        flat = np.concatenate([np.append(i, np.uint32(0)) for _, _, i in docs]).astype(np.int64)
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        held = np.array([h for _, h, _ in docs], bool)
        doc = np.repeat(np.arange(len(docs), dtype=np.int32) * 2 + held, sizes).astype(np.int32)
        ids = np.array([0 if d is None else d for d, _, _ in docs], np.int64)
        own = classes[flat]
        blob = pack(ids, np.array([d is None for d, _, _ in docs], np.uint8), held.astype(np.uint8), sizes, own.astype(np.uint8))
        yield _row(_PACKED, route=[2**40 + chunk % 1024], kind=[_DOCS], chunk=[chunk], blob=[blob])
        yield _row(_PACKED, route=[2**40 + chunk % 1024], kind=[_ENDS], chunk=[chunk], n=[int((~held).sum())])
        train = ~np.repeat(held, sizes)
        code, n = np.unique((contexts(own, starts) * CLASSES + own)[train], return_counts=True)
        cuts = np.searchsorted(code, np.arange(0, CLASSES**3 + 1, 1 << 18))
        for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
            if y > x:
                yield _row(_PACKED, route=[-1 - k], kind=[_GRAMS], chunk=[chunk], blob=[pack(code[x:y].astype(np.int32), n[x:y].astype(np.int32))])
        one, two = two_before(hashes[flat], starts, 0)
        rank = np.lexsort((np.arange(len(words)), routes))
        place = np.empty(len(words), np.int64)
        place[rank] = np.arange(len(words))
        at = np.argsort(place[flat], kind="stable")
        often = np.bincount(place[flat], minlength=len(words))
        upto = np.r_[0, np.cumsum(often)]
        edges = np.flatnonzero(np.r_[True, np.diff(routes[rank]) != 0, True])
        for x, y in zip(edges.tolist(), edges[1:].tolist()):
            route = int(routes[rank[x]])
            if route % CLASSES != END_CLASS:
                some = at[upto[x] : upto[y]]
                named = np.frombuffer(b" ".join(words[k] for k in rank[x:y].tolist()), np.uint8)
                yield _row(_PACKED, route=[route], kind=[_TOKENS], chunk=[chunk], blob=[pack(one[some], two[some], doc[some], often[x:y].astype(np.int32), named)])

    def run(batches):
        numbers, docs, size, chunk = None, [], 0, 0
        for batch in batches:
            ids, held, texts = (batch.column(k) for k in range(3))
            for k in range(batch.num_rows):
                if numbers is None:
                    fresh = count(1)
                    numbers, docs, size, chunk = {END: 0}, [], 0, uuid.uuid4().int >> 65
                    number = numbers.setdefault
                text = texts[k].as_py()
                found = tokens(text)
                for w in set(found).difference(numbers):
                    number(w, next(fresh))
                docs.append((ids[k].as_py(), held[k].as_py(), np.fromiter(map(numbers.__getitem__, found), np.uint32, len(found))))
                size += len(text)
                if size >= chunk_bytes:
                    yield from finish(chunk, numbers, docs)
                    numbers = None
        if numbers is not None:
            yield from finish(chunk, numbers, docs)

    return run


@dataclass(frozen=True)
class Tree:
    """Binary decisions that lead to each leaf: ``node`` and ``bit`` of leaf k from ``start[k]`` to ``start[k + 1]``; log odds by node."""

    start: np.ndarray
    node: np.ndarray
    bit: np.ndarray
    odds: np.ndarray


def tree(weight: np.ndarray) -> Tree:
    """A tree over leaves of these weights, halved by weight from the heaviest on; its odds give each leaf its share."""
    order = np.argsort(-weight, kind="stable")
    total = np.r_[0, np.cumsum(weight[order])].astype(float)
    low, high, nodes = np.array([0]), np.array([len(weight)]), 0
    leaves, names, bits, odds = [], [], [], []
    while True:
        some = high - low > 1
        low, high = low[some], high[some]
        if not len(low):
            break
        mid = np.clip(np.searchsorted(total, (total[low] + total[high]) / 2), low + 1, high - 1)
        size = high - low
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
        leaves.append(order[at])
        names.append(np.repeat(nodes + np.arange(len(low)), size))
        bits.append(at >= np.repeat(mid, size))
        odds.append(np.log((total[high] - total[mid]) / (total[mid] - total[low])))
        nodes += len(low)
        low, high = np.stack([low, mid], 1).ravel(), np.stack([mid, high], 1).ravel()
    none = np.zeros(0, np.int64)
    leaf, node, bit = (np.concatenate(v) if v else none for v in (leaves, names, bits))
    by = np.argsort(leaf, kind="stable")
    start = np.r_[0, np.cumsum(np.bincount(leaf, minlength=len(weight)))]
    return Tree(start, node[by], bit[by].astype(bool), np.concatenate(odds) if odds else np.zeros(0))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def word_features(one: np.ndarray, two: np.ndarray) -> list[np.ndarray]:
    """Hashed features of the words before: 2-gram, skip, 3-gram."""
    a, b = one.astype(np.uint64) + np.uint64(1), two.astype(np.uint64) + np.uint64(1)
    return [_mixed(k) for k in (a * np.uint64(0x9E3779B97F4A7C15), b * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x51ED27), a * np.uint64(0xD6E8FEB86659FD93) + b * np.uint64(0xA0761D6478BD642F))]


def _decisions(paths: Tree, bits: int, leaf: np.ndarray, one: np.ndarray, two: np.ndarray, wanted: np.ndarray | None = None, step: int = 65_536):
    """For slices of the wanted tokens: the tokens, their decisions' owners and names, and the weights' places by feature."""
    depth = np.diff(paths.start)
    named = _mixed((np.arange(len(paths.odds), dtype=np.uint64) + np.uint64(1)) * np.uint64(0x94D049BB133111EB))
    for x in range(0, len(leaf), step):
        part = np.arange(x, min(len(leaf), x + step))
        if wanted is not None:
            part = part[wanted[part]]
        own = leaf[part]
        size = depth[own]
        upto = np.cumsum(size)
        if len(part) and upto[-1]:
            owner = np.repeat(np.arange(len(part)), size)
            at = np.arange(upto[-1]) + np.repeat(paths.start[own] - (upto - size), size)
            node = paths.node[at]
            salt = named[node]
            places = [((np.repeat(f, size) + salt) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).view(np.int64) for f in word_features(one[part], two[part])]
            yield part, owner, node, paths.bit[at], places


def train_words(paths: Tree, leaf: np.ndarray, one: np.ndarray, two: np.ndarray, seen: np.ndarray, updates: int = 2, rate: float = 0.4, damping: float = 1.0) -> np.ndarray:
    """Weights of the decisions' hashed features: each update adds up slope and curvature over all training tokens."""
    met = int(np.bincount(leaf[seen], minlength=len(paths.start) - 1) @ np.diff(paths.start))
    bits = int(np.clip(np.ceil(np.log2(met + 1)), 8, np.log2(MOST_WEIGHTS)))
    weights = np.zeros(1 << bits, np.float32)
    for k in range(updates):
        slope, curve = np.zeros(1 << bits), np.zeros(1 << bits)
        for _, _, node, bit, places in _decisions(paths, bits, leaf, one, two, seen):
            p = 1 / (1 + np.exp(-paths.odds[node] - (sum(weights[at] for at in places) if k else 0)))
            miss, bend = bit - p, p * (1 - p)
            for at in places:
                np.add.at(slope, at, miss)
                np.add.at(curve, at, bend)
        curve += damping
        slope -= 0.1 * weights
        slope *= rate
        slope /= curve
        weights += slope.astype(np.float32)
    return weights


def word_log_probabilities(paths: Tree, weights: np.ndarray, leaf: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Natural log of P(leaf | words before) of each token."""
    out = np.zeros(len(leaf))
    bits = len(weights).bit_length() - 1
    for part, owner, node, bit, places in _decisions(paths, bits, leaf, one, two):
        z = paths.odds[node] + sum(weights[at] for at in places)
        out[part] = np.bincount(owner, -np.log1p(np.exp(np.where(bit, -z, z))), len(part))
    return out


def _routed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """What a route's task makes: class 3-gram counts added up, documents as they are, or sums by document of a bucket."""
    route = key[0].as_py()
    if route >= 2**40:
        return table.select([c.split()[0] for c in _PACKED.split(", ")])
    blobs = table.column("blob").to_pylist()
    if route < 0:
        low = (-1 - route) << 18
        total = np.zeros(1 << 18, np.int64)
        for blob in blobs:
            code, n = unpack(blob)
            total[code - low] += n
        at = np.flatnonzero(total)
        return pa.Table.from_batches([_row(_PACKED, kind=np.full(len(at), _GRAMS, np.int32), code=(at + low).astype(np.int32), n=total[at])])
    numbers = {w: k for k, w in enumerate(sorted({w for blob in blobs for w in unpack(blob)[4].tobytes().split(b" ")}))}
    parts, sizes = [], []
    for blob in blobs:
        one, two, doc, often, named = unpack(blob)
        own = named.tobytes().split(b" ")
        parts.append((one, two, doc, np.repeat(np.fromiter(map(numbers.__getitem__, own), np.int32, len(own)), often)))
        sizes.append(len(doc))
    del blobs, numbers
    one, two, doc, word = (np.concatenate(v) for v in zip(*parts))
    del parts
    seen = doc & 1 == 0
    c = np.bincount(word[seen], minlength=word.max() + 1)
    known = np.flatnonzero(c)
    leaf_of = np.full(len(c), len(known), np.int32)  # the last leaf is the unknown token
    leaf_of[known] = np.arange(len(known))
    paths = tree(np.r_[c[known] + 1, 1])
    leaf = leaf_of[word]
    weights = train_words(paths, leaf, one, two, seen)
    base, out, end = np.log10(c + 1), [], 0
    for size in sizes:
        part = slice(end, end := end + size)
        own, which = np.unique(doc[part] >> 1, return_inverse=True)
        score = word_log_probabilities(paths, weights, leaf[part], one[part], two[part]) / np.log(10)
        sums = [np.bincount(which, v, len(own)) for v in (np.ones(size), c[word[part]] > 0, base[word[part]], score)]
        out.append(pack(own.astype(np.int32), sums[0].astype(np.int32), sums[1].astype(np.int32), sums[2], sums[3].astype(np.float32)))
    rows = [_row(_PACKED, kind=[_SUMS] * len(out), chunk=table.column("chunk").to_pylist(), blob=out, code=[route] * len(out)), _row(_PACKED, kind=[_TOTALS], chunk=[len(known)], code=[route], n=[int(c.sum())])]
    return pa.Table.from_batches(rows)


@dataclass(frozen=True)
class Model:
    """Class factor (``weights``, ``bias``), log10 share of each bucket (by route) in its class, training documents, and
    ``total`` and ``distinct`` training tokens."""

    weights: np.ndarray
    bias: np.ndarray
    share: np.ndarray
    ends: int
    total: int
    distinct: int


def _update(shared):
    """One task's part of what the model expects and of what it misses, by feature; feature -1 is the bias."""

    def run(batches):
        weights, bias = shared.value
        slope, expected, touched = np.zeros_like(weights), np.zeros_like(weights), np.zeros(len(weights), bool)
        slope0, expected0 = np.zeros_like(bias), np.zeros_like(bias)
        for batch in batches:
            context = np.asarray(batch.column(0))
            counts = batch.column(1).flatten().to_numpy().reshape(-1, CLASSES).astype(float)
            for start in range(0, len(context), 2048):
                at, n = features(context[start : start + 2048]), counts[start : start + 2048]
                e = np.exp(log_probabilities(weights, bias, context[start : start + 2048])) * n.sum(1, keepdims=True)
                for k in range(at.shape[1]):
                    np.add.at(slope, at[:, k], e - n)
                    np.add.at(expected, at[:, k], e)
                    touched[at[:, k]] = True
                slope0 += (e - n).sum(0)
                expected0 += e.sum(0)
        own = np.flatnonzero(touched)
        at = np.r_[own, -1].astype(np.int32)
        values = [np.vstack([slope[own], slope0]), np.vstack([expected[own], expected0])]
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(list(v), pa.list_(pa.float64())) for v in values)], names=["feature", "slope", "expected"])

    return run


def train(spark, grams: DataFrame, updates: int = 16, rate: float = 0.5, damping: float = 5.0) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the class factor from ``code, n``: counts of class 3-grams over all training tokens.

    There are ``CLASSES ** 2`` contexts at most. Each update sends the weights out, adds up gradient and expectation by
    feature, and steps along the gradient, scaled by the larger of expected and met counts plus ``damping``.
    """
    cells = grams.select(F.expr(f"code div {CLASSES}").cast("int").alias("context"), (F.col("code") % CLASSES).alias("cls"), "n")
    lists = cells.groupBy("context").agg(F.map_from_entries(F.collect_list(F.struct("cls", "n"))).alias("m"))
    row = F.transform(F.sequence(F.lit(0), F.lit(CLASSES - 1)), lambda c: F.coalesce(F.element_at("m", c), F.lit(0)).cast("long"))
    rows = common.written(lists.select("context", row.alias("counts")).coalesce(8))
    weights, bias = np.zeros((FEATURES, CLASSES)), np.zeros(CLASSES)
    for r in rows.select(F.posexplode("counts").alias("cls", "n")).groupBy("cls").agg(F.sum("n").alias("n")).collect():
        bias[r.cls] = np.log(r.n + 1)
    for _ in range(updates):
        shared = spark.sparkContext.broadcast((weights, bias))  # of fixed size
        parts = rows.mapInArrow(_update(shared), "feature int, slope array<double>, expected array<double>").toArrow()  # features times tasks at most
        at = np.asarray(parts.column("feature"))
        slope, expected = np.zeros((FEATURES + 1, CLASSES)), np.zeros((FEATURES + 1, CLASSES))
        for name, to in (("slope", slope), ("expected", expected)):
            np.add.at(to, at, parts.column(name).combine_chunks().flatten().to_numpy().reshape(-1, CLASSES))
        slope[:-1] += 0.1 * weights
        step = rate * slope / (np.maximum(expected, expected - slope) + damping)
        weights, bias = weights - step[:-1], bias - step[-1]
        shared.destroy()  # else a copy of every update's weights stays on disk
    return weights.astype(np.float32), bias


def score(docs: DataFrame, chunk_bytes: int = 8_000_000, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Per row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of its whole text.

    The base is the add-one unigram model; both scores are log10 probabilities. Texts null or empty have one token,
    the end. Repeated rows stay and count as often as they occur; a null id counts as the empty text for the split.
    Without training rows every token is unknown. ``bucket_bytes``: a class is cut into as many buckets of words as the
    texts have such parts; a bucket's share in its class does not see the words before.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(common.whole_text()).cast("long"))).first()[0] or 0
    buckets = 1 + size // bucket_bytes
    parts = common.written(chunks(docs, chunk_bytes, buckets).groupBy("route").applyInArrow(_routed, _PACKED))
    weights, bias = train(spark, parts.where(F.col("kind") == _GRAMS).select("code", "n"))
    ends = parts.where(F.col("kind") == _ENDS).agg(F.sum("n")).first()[0] or 0
    totals = parts.where(F.col("kind") == _TOTALS).select("code", "n", F.col("chunk").alias("v")).collect()  # one row a bucket
    mass = np.zeros((buckets, CLASSES))
    for r in totals:
        mass[divmod(r.code, CLASSES)] = r.n + r.v + 1
    with np.errstate(divide="ignore", invalid="ignore"):
        share = np.log10(mass / mass.sum(0)).ravel()
    model = Model(weights, bias, share, ends, sum(r.n for r in totals) + ends, sum(r.v for r in totals) + (ends > 0))
    shared = spark.sparkContext.broadcast(model)  # of fixed size but for a number a bucket
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return parts.where(F.col("kind").isin(_DOCS, _SUMS)).select("chunk", "kind", "code", "blob").groupBy("chunk").applyInArrow(_scored(shared), out)


def _scored(shared):
    def run(table: pa.Table) -> pa.Table:
        model = shared.value
        rows = list(zip(*(table.column(c).to_pylist() for c in ("kind", "code", "blob"))))
        ids, missing, held, sizes, classes = unpack(next(blob for kind, _, blob in rows if kind == _DOCS))
        n = len(ids)
        n_known, base, words = np.full(n, int(model.ends > 0), np.int64), np.full(n, np.log10(model.ends + 1)), np.zeros(n)
        for kind, route, blob in sorted((r for r in rows if r[0] == _SUMS), key=lambda r: r[1]):  # sums always add up in the same order
            doc, often, known, base_sum, word_sum = unpack(blob)
            n_known[doc] += known
            base[doc] += base_sum
            words[doc] += word_sum + often * model.share[route]
        base -= sizes * np.log10(model.total + model.distinct + 1)
        ends = np.cumsum(sizes)
        scores = []
        for start, end in common.slices(sizes.tolist(), 2_000_000):
            starts = np.r_[0, ends[start:end][:-1] - (ends[start] - sizes[start])]
            own = classes[ends[start] - sizes[start] : ends[end - 1]].astype(np.int64)
            met, which = np.unique(contexts(own, starts), return_inverse=True)
            factor = np.empty(len(own))
            order = np.argsort(which, kind="stable")
            bounds = np.searchsorted(which[order], np.arange(0, len(met) + 2048, 2048))
            for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                logs = log_probabilities(model.weights, model.bias, met[2048 * k : 2048 * (k + 1)])
                factor[order[a:b]] = logs[which[order[a:b]] - 2048 * k, own[order[a:b]]]
            scores.append(np.add.reduceat(factor / np.log(10), starts))
        scored = np.concatenate(scores) + words
        return pa.table([pa.array(ids, pa.int64(), mask=missing.astype(bool)), pa.array(held.astype(bool)), pa.array(sizes), pa.array(n_known), pa.array(np.full(n, model.total, np.int64)), pa.array(base), pa.array(scored)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run
