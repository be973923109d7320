"""Suffix-array dedup: bytes covered by a string of ``length`` bytes that also starts anywhere else.

The suffix array is built by linear grouping. Suffixes are first grouped by their first symbol. Groups are processed
from the highest to the lowest; each suffix of a group finds its previous suffix of a lower group by pointers, and
those move up behind their group, the more often they are met the higher. What is left are groups of suffixes with
equal Lyndon prefixes, in order, and one pass from the smallest suffix emits the order within them. Nothing is ever
renamed or built again for a shorter string.

At scale, equal strings must meet. Every window of ``length`` bytes has an anchor, its least 16-gram by hash, so equal
windows have equal anchors at equal offsets. The windows of an anchor form a fragment. Fragments that occur twice are
repeated as a whole; anchors met once hold nothing. Only different fragments of one anchor need sorting: they become
sequences of 32-byte blocks counted from the anchor, and suffixes that share their first blocks are neighbours in the
suffix array. The bytes before and after these blocks are then compared exactly. Anchors with very many different
fragments would make a hot task; they are split by hashes of these blocks instead.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import partitions_for, released, whole_text, written

GRAM, BLOCK = 16, 32
PLACE = np.uint64(32)  # hashes are compared by their upper bits; ties go to the first place
MOST_HEAVY = 1000  # heavy anchors each have more than this part of all rows
MOST_FRAGMENTS = 2000  # different fragments of an anchor that a suffix array takes at once; at most 1.6 MB of text
END, GAP = 0, 1  # symbols: of the text's end and between fragments


def suffix_array(symbols: list[int]) -> list[int]:
    """Order of the suffixes of ``symbols``, whose last symbol is the only smallest one."""
    n = len(symbols)
    t = np.asarray(symbols, np.int64)
    by_first = np.argsort(t, kind="stable")
    order = by_first.tolist()  # by group; a group is named by where it starts
    new = np.r_[True, np.diff(t[by_first]) != 0] if n else np.zeros(0, bool)
    first = np.flatnonzero(new)
    starts = np.repeat(first, np.diff(np.r_[first, n]))
    where = np.empty(n, np.int64)
    where[by_first] = np.arange(n)
    place = where.tolist()
    group = starts[where].tolist()
    stop = np.zeros(n + 1, np.int64)
    stop[first] = np.r_[first[1:], n]
    stop = stop.tolist()  # by group: one past its last place
    before = [-1] * n  # previous suffix of a lower group
    high = n
    while high > 0:
        low = group[order[high - 1]]
        if high - low == 1:
            i = order[low]
            p = i - 1
            while p >= 0 and group[p] >= low:
                p = before[p]
            before[i] = p
            if p >= 0:
                old = group[p]
                last = stop[old] - 1
                if old != last:  # else it is alone there, and stays
                    q, at = order[last], place[p]
                    order[at], order[last] = q, p
                    place[q], place[p] = at, last
                    stop[old], stop[last] = last, last + 1
                    group[p] = last
            high = low
            continue
        met: dict[int, int] = {}
        for i in sorted(order[low:high]):
            p = i - 1
            while p >= 0 and group[p] >= low:
                p = before[p]
            before[i] = p
            if p >= 0:
                met[p] = met.get(p, 0) + 1
        by_count: dict[int, list] = {}
        for p, k in met.items():
            by_count.setdefault(k, []).append(p)
        for k in sorted(by_count, reverse=True):
            moved: dict[int, list] = {}
            for p in by_count[k]:
                moved.setdefault(group[p], []).append(p)
            for old, some in moved.items():
                end = stop[old]
                begin = end - len(some)
                if begin == old:
                    continue  # the whole group
                last = end
                for p in some:
                    last -= 1
                    q, at = order[last], place[p]
                    if q != p:
                        # what stands at the back may itself be one of those that move
                        order[at], order[last] = q, p
                        place[q], place[p] = at, last
                for p in some:
                    group[p] = begin
                stop[old], stop[begin] = begin, end
        high = low
    out = [-1] * n
    free = list(range(n))  # by group: its next place
    done = bytearray(n)
    if n:
        out[0] = n - 1
        done[n - 1] = 1
    for k in range(n):
        s = out[k] - 1
        while s >= 0 and not done[s]:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            done[s] = 1
            s = before[s]
    return out


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end: anchor hashes, first and last window starts, and anchor places, a row a fragment."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none
    wide = np.zeros(n + GRAM, np.uint64)
    wide[:n] = data
    eight = wide[: n + 8].copy()
    for k in range(1, 8):
        eight[: n + 8 - k] |= wide[k : n + 8] << np.uint64(8 * k)
    h = eight[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h += eight[8 : n + 8] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    span = length - GRAM + 1  # places of an anchor within a window
    rows = -(-n // span)
    value = np.full(rows * span, np.uint64(2**64 - 1))
    value[:n] = (h >> PLACE << PLACE) | np.arange(n, dtype=np.uint64)
    table = value.reshape(rows, span)
    left = np.minimum.accumulate(table, axis=1).ravel()
    right = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(right[: n - length + 1], left[span - 1 : span - 1 + n - length + 1])
    at = (least & np.uint64(2**32 - 1)).astype(np.int64)
    ok = np.zeros(n + 1, np.int64)
    starts = np.r_[0, ends[:-1]]
    long = ends - starts >= length
    ok[starts[long]] += 1
    ok[ends[long] - length + 1] -= 1
    ok = np.cumsum(ok)[: n - length + 1] > 0
    new = ok & np.r_[True, (at[1:] != at[:-1]) | ~ok[:-1]]
    first = np.flatnonzero(new)
    over = ok & np.r_[(at[1:] != at[:-1]) | ~ok[1:], True]
    last = np.flatnonzero(over)
    return h[at[first]].view(np.int64), first, last, at[first]


def _fragments(length: int):
    """Occurrences of fragments: a row each, and a row for each text with its size and SHA-256."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            raw = [t.as_py().encode() for t in texts]
            keys = [xxhash.xxh3_64_intdigest(r) - 2**63 for r in raw]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.int64()), pa.array([len(r) for r in raw], pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string()), *(pa.nulls(len(raw), t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))],
                names=_NAMES,
            )
            for start, end in common.slices([len(r) for r in raw], 1_000_000):
                joined = b"".join(raw[start:end])
                ends = np.cumsum([len(r) for r in raw[start:end]])
                anchor, first, last, place = anchors(np.frombuffer(joined, np.uint8), ends, length)
                if len(anchor):
                    text = np.searchsorted(ends, first, side="right")
                    begin = np.r_[0, ends[:-1]][text]
                    own = np.array(keys[start:end])[text]
                    bodies = [xxhash.xxh3_64_intdigest(joined[a : b + length]) - 2**63 for a, b in zip(first.tolist(), last.tolist())]
                    size = len(own)
                    yield pa.RecordBatch.from_arrays([pa.nulls(size, pa.int64()), pa.array(own), pa.nulls(size, pa.int64()), pa.nulls(size, pa.string()), pa.array(anchor), pa.array(bodies, pa.int64()), pa.array((first - begin).astype(np.int32)), pa.array((last - begin).astype(np.int32)), pa.array((place - first).astype(np.int32))], names=_NAMES)

    return run


_NAMES = ["doc_id", "text_key", "n_bytes", "sha", "anchor", "body", "first", "last", "at"]
_SCHEMA = "doc_id long, text_key long, n_bytes long, sha string, anchor long, body long, first int, last int, at int"


def _cut(length: int, hot: bool):
    """Fragments of the texts that are asked for: their bytes, and where the anchor is."""

    def run(batches):
        for batch in batches:
            out = [[], [], [], []]
            total = 0
            for k in range(batch.num_rows):
                raw = batch.column(0)[k].as_py().encode()
                for part in batch.column(1)[k].as_py():
                    if part["hot"] is not hot:
                        continue
                    a, b = part["first"], part["last"]
                    piece = raw[a : b + length]
                    out[0].append(part["anchor"])
                    out[1].append(part["body"])
                    out[2].append(part["at"])
                    out[3].append(piece)
                    total += len(piece)
                if total > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary())], names=["anchor", "body", "at", "piece"])
                    out, total = [[], [], [], []], 0
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary())], names=["anchor", "body", "at", "piece"])

    return run


def repeated_windows(fragments: list[tuple[int, int, bytes]], length: int) -> list[tuple[int, int] | None]:
    """For fragments (anchor, anchor's place, bytes): first and last window start that another fragment also has.

    All windows of a fragment hold its anchor, so the bytes from the first to the end of the last are covered.
    """
    whole = (length - BLOCK + 1) // BLOCK  # blocks that every window holds in full
    symbols, owner, block, names = [], [], [], {}
    for k, (anchor, at, piece) in enumerate(fragments):
        base = at % BLOCK
        for j in range((len(piece) - base) // BLOCK):
            a = base + BLOCK * j
            key = (anchor, a - at, piece[a : a + BLOCK])
            name = names.get(key)
            if name is None:
                name = names[key] = len(names) + 2
            symbols.append(name)
            owner.append(k)
            block.append(a)
        symbols.append(GAP)
        owner.append(-1)
        block.append(0)
    symbols.append(END)
    order = np.array(suffix_array(symbols), np.int64)
    t = np.r_[np.array(symbols, np.int64), np.zeros(whole, np.int64)]
    same = np.ones(max(0, len(order) - 1), bool)
    for k in range(whole):
        x = t[order + k]
        same &= (x[1:] == x[:-1]) & (x[1:] > GAP)
    out: list = [None] * len(fragments)
    edges = np.flatnonzero(np.diff(np.r_[False, same, False].astype(np.int8)))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        members = order[a : b + 1].tolist()
        _meet([(owner[i], block[i]) for i in members], fragments, length, whole, out)
    return out


def _meet(members: list, fragments: list, length: int, whole: int, out: list) -> None:
    """Members (fragment, place) share ``whole`` blocks there: which of the windows around these are equal."""
    core, rest = whole * BLOCK, length - whole * BLOCK
    sides = []
    for k, a in members:
        piece = fragments[k][2]
        sides.append((k, a, piece[max(0, a - BLOCK + 1) : a][::-1], piece[a + core : a + core + rest]))
    if len(sides) <= 6:
        for x, (k, a, left, right) in enumerate(sides):
            for k2, a2, left2, right2 in sides[x + 1 :]:
                if k2 != k:
                    back, ahead = _common(left, left2), _common(right, right2)
                    if back + ahead >= rest:
                        least = max(0, rest - ahead)
                        _note(out, k, a - back, a - least)
                        _note(out, k2, a2 - back, a2 - least)
        return
    for h in range(BLOCK):
        seen: dict = {}
        for k, a, left, right in sides:
            if len(left) >= h and len(right) >= rest - h:
                seen.setdefault((left[:h], right[: rest - h]), []).append((k, a))
        for some in seen.values():
            if len(some) > 1:
                for k, a in some:
                    _note(out, k, a - h, a - h)


def _note(out: list, k: int, low: int, high: int) -> None:
    own = out[k]
    out[k] = (low, high) if own is None else (min(low, own[0]), max(high, own[1]))


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    k = 0
    while a[k] == b[k]:
        k += 1
    return k


def _sorted_blocks(length: int, block_bytes: int = 600_000):
    """Fragments in order of their anchors: suffix arrays over whole anchors, up to ``block_bytes`` each."""

    def rows(held):
        found = repeated_windows([(a, at, p) for a, _, at, p in held], length)
        good = [(a, b, *w) for (a, b, _, _), w in zip(held, found) if w]
        columns = list(zip(*good)) if good else [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32())], names=["anchor", "body", "low", "high"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if size >= block_bytes and row[0] != held[-1][0]:
                    yield rows(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield rows(held)

    return run


def _cores(length: int):
    """Of every 32nd place of a fragment, counted from its anchor: the blocks that all windows near it hold, and these
    with the bytes around that a window may hold too, under 128-bit hashes. Places that no window is near are left out."""
    whole = (length - BLOCK + 1) // BLOCK * BLOCK

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(5)]
            for anchor, body, at, piece in zip(*(batch.column(k).to_pylist() for k in range(4))):
                for a in range(at % BLOCK, len(piece) - length + BLOCK, BLOCK):
                    around = piece[max(0, a - BLOCK + 1) : a + length]
                    for column, v in zip(out, (anchor, body, a, a - at, xxhash.xxh3_128_digest(piece[a : a + whole]) + xxhash.xxh3_128_digest(around + b"%d" % min(a, BLOCK - 1)))):
                        column.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["anchor", "body", "place", "off", "both"])

    return run


def _windows(length: int):
    """The windows around the places asked for, each under a 128-bit hash."""

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(4)]
            for anchor, body, piece, places in zip(*(batch.column(k).to_pylist() for k in range(4))):
                for a in places:
                    for p in range(max(0, a - BLOCK + 1), min(a, len(piece) - length) + 1):
                        for column, v in zip(out, (anchor, body, xxhash.xxh3_128_digest(piece[p : p + length]), p)):
                            column.append(v)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["anchor", "body", "window", "at"])

    return run


def split_anchors(cut: DataFrame, length: int) -> DataFrame:
    """What :func:`repeated_windows` finds, for anchors whose fragments are too many for one task: by hashes of what the
    windows around a place share. Places met once drop out; where the bytes around are met again too, all windows are
    repeats; only the windows of what is left meet one by one."""
    cores = written(cut.select("anchor", "body", "at", "piece").mapInArrow(_cores(length), "anchor long, body long, place int, off int, both binary"))
    named = cores.select("anchor", "body", "place", "off", F.substring("both", 1, 16).alias("core"), F.substring("both", 17, 16).alias("around"))
    key = ["anchor", "off", "core"]
    kinds = written(named.groupBy(*key, "around").agg(F.count("*").alias("n"), F.min(F.struct("body", "place")).alias("one")))
    places = kinds.groupBy(*key).agg(F.sum("n").alias("total"), F.min("n").alias("least")).where("total > 1")
    sizes = cut.select("anchor", "body", (F.octet_length("piece") - length).alias("top"))
    alike = named.join(kinds.where("n > 1").select(*key, "around"), [*key, "around"]).groupBy("anchor", "body").agg(F.min("place").alias("low"), F.max("place").alias("high"))
    sure = alike.join(sizes, ["anchor", "body"]).select("anchor", "body", F.greatest(F.lit(0), F.col("low") - (BLOCK - 1)).alias("low"), F.least("high", "top").alias("high"))
    # one of each kind at the places where some kind is met once: its windows may equal those of any other kind
    asked = kinds.join(places.where("least = 1"), key).groupBy("anchor", F.col("one.body").alias("body")).agg(F.collect_list("one.place").alias("places"))  # as many as a fragment has
    windows = written(cut.select("anchor", "body", "piece").join(asked, ["anchor", "body"]).select("anchor", "body", "piece", "places").mapInArrow(_windows(length), "anchor long, body long, window binary, at int"))
    twice = windows.groupBy("anchor", "window").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "window")
    met = windows.join(twice, ["anchor", "window"]).groupBy("anchor", "body").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    out = written(sure.union(met))
    released(cores, kinds, windows, cut)
    return out


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans joined where they overlap or touch."""
    out: list = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _kept():
    def run(batches):
        for batch in batches:
            out = []
            for key, text, spans in zip(*(batch.column(k).to_pylist() for k in range(3))):
                raw = text.encode()
                runs = merge_spans([(s["a"], s["b"]) for s in spans])
                edges = [0, *(x for r in runs for x in r), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((key, len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept.decode(errors="replace")))
            columns = list(zip(*out)) if out else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["text_key", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    return run


def dedup(docs: DataFrame, length: int = 400, most_fragments: int | None = None) -> DataFrame:
    """Per row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and ``kept_text`` (null where nothing is removed;
    bytes that no longer form a character are replaced there, not in the digest).

    Null texts count as empty. Strings are judged on the input, in any row, the same one included, never across rows;
    repeated rows and exact copies are repeats of each other. Null ids stay. Equal texts are told by a 64-bit hash,
    equal fragments by a 128-bit one (anchor and body). ``most_fragments``: different fragments of an anchor beyond
    which it is split (:func:`split_anchors`), a fixed number, as a task holds an anchor's fragments.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    rows = written(narrow.mapInArrow(_fragments(length), _SCHEMA))
    texts_of = written(rows.where("n_bytes IS NOT NULL").select("doc_id", "text_key", "n_bytes", "sha"))
    every = rows.where("anchor IS NOT NULL").select("text_key", "anchor", "body", "first", "last", "at")
    often = written(every.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"))
    met = written(_with_groups(every, often, "n").drop("n"))  # an anchor met once holds no repeat
    released(often, rows)
    bodies = written(met.groupBy("anchor", "body").agg(F.count("*").alias("n"), F.min(F.struct("text_key", "first", "last", "at")).alias("one")))
    groups = written(bodies.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("n").alias("least")))
    differing = written(_with_groups(bodies, groups.where("kinds > 1 AND least = 1"), "kinds"))
    released(groups)
    whole = bodies.where("n > 1").select("anchor", "body", F.lit(0).alias("low"), (F.col("one.last") - F.col("one.first")).alias("high"))

    n = 4 * partitions_for(spark)
    most = most_fragments or MOST_FRAGMENTS
    hot = F.col("kinds") > most
    any_hot = bool(differing.where(hot).limit(1).count())
    asked = differing.select(F.col("one.text_key").alias("text_key"), F.struct("anchor", "body", F.col("one.first").alias("first"), F.col("one.last").alias("last"), F.col("one.at").alias("at"), hot.alias("hot")).alias("part"))
    lists = asked.groupBy("text_key").agg(F.collect_list("part").alias("parts"))  # as many as a text has
    touched = met.select("text_key").distinct()
    any_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    wanted = texts_of.join(touched, "text_key", "left_semi").groupBy("text_key").agg(F.min(any_id).alias("id"))
    wanted = wanted.join(lists, "text_key", "left").hint("shuffle_hash")
    found = narrow.withColumn("id", any_id).join(wanted, "id").select("text_key", "text", "parts").mapInArrow(_own, "text_key long, text string, parts array<struct<anchor:bigint,body:bigint,first:int,last:int,at:int,hot:boolean>>")
    if texts_of.groupBy(any_id).agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        found = found.dropDuplicates(["text_key"])  # else each text has come once already
    found = written(found)
    released(differing)

    piece = "anchor long, body long, at int, piece binary"
    cut = found.where("parts IS NOT NULL").select("text", "parts")
    calm = cut.mapInArrow(_cut(length, False), piece).repartition(n, "anchor").sortWithinPartitions("anchor", "body")
    result = written(calm.mapInArrow(_sorted_blocks(length), "anchor long, body long, low int, high int"))
    far = split_anchors(written(cut.mapInArrow(_cut(length, True), piece)), length) if any_hot else None
    both = result if far is None else result.union(far)
    repeats = written(whole.union(both).groupBy("anchor", "body").agg(F.min("low").alias("low"), F.max("high").alias("high")))
    released(result, far, bodies)

    spans = met.join(repeats, ["anchor", "body"]).select("text_key", (F.col("first") + F.col("low")).alias("a"), (F.col("first") + F.col("high") + length).alias("b")).distinct()
    by_text = spans.groupBy("text_key").agg(F.collect_list(F.struct("a", "b")).alias("spans"))  # as many as a text has
    by_text = written(by_text)
    released(met, repeats)
    done = written(found.select("text_key", "text").join(by_text, "text_key").mapInArrow(_kept(), "text_key long, n_removed long, n_spans long, kept_sha256 string, kept_text string"))
    released(found, by_text)
    zero = F.lit(0).cast("long")
    return texts_of.join(done, "text_key", "left").select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), "kept_text")


def _with_groups(rows: DataFrame, groups: DataFrame, size: str) -> DataFrame:
    """Rows of the anchors in ``groups`` (``anchor`` and ``size``, its rows among all), with that size.

    Anchors that have a good share of all rows are few by that share itself: they are broadcast, so that none of their
    rows goes to one task. The others meet by a shuffle.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    heavy = groups.where(F.col(size) > F.lit(total / MOST_HEAVY)).select("anchor", size)  # under MOST_HEAVY rows
    light = groups.where(F.col(size) <= F.lit(total / MOST_HEAVY)).select("anchor", size)
    apart = rows.join(F.broadcast(heavy), "anchor")
    rest = rows.join(F.broadcast(heavy.select("anchor")), "anchor", "left_anti").join(light, "anchor")
    return apart.unionByName(rest)


def _own(batches):
    """Rows whose text has the key that was asked for (ids may repeat)."""
    for batch in batches:
        keys = [xxhash.xxh3_64_intdigest(t.as_py().encode()) - 2**63 for t in batch.column(1)]
        yield batch.filter(pa.array([k == w for k, w in zip(keys, batch.column(0).to_pylist())], pa.bool_()))
