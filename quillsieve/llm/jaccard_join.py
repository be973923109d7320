"""N-gram Jaccard join: universe-partition pigeonhole with one-deletion neighbourhoods and cost-based allocation.

Distinct shingles are hashed into the segments of a size tier. Two sets of Jaccard similarity t and more differ in at
most h shingles (h depends on the tier's largest size), so if segment i may differ in fewer than e_i shingles and the
e_i add up to more than h, some segment agrees within its own bound. e_i is 1 (equal segments meet) but for the first
segment, where it is 2 (equal up to one shingle: its one-deletion neighbourhood is indexed too), and, where a set's size
leaves segments to spare, 0 for the segments whose signatures are the most frequent in the corpus: those are indexed,
but do not look for partners. The first segment may be one of these, in place of two others, by what either leaves to
look through. The smaller set of a pair asks, so a set asks in its own tier alone. Tiers are size ranges; a set near the
lower end of its tier is indexed in the tier below too.

A set also has a bitmap with a bit flipped for each shingle. Two bitmaps differ in no more bits than their sets differ
in shingles, so pairs within a signature are first held against that bound; what passes is verified on the texts. A
signature's members are first held against hubs, the members with most shared signatures, then against the least
partner that passes the bound, as long as that makes links; what is connected then needs no further test. Last come
all pairs that pass and are still apart, so no link between different components is lost. These are mostly close misses,
so those members that still have such pairs get longer bitmaps, whose bound is nearly the true difference.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import graph
from .common import free_names, partitions_for, released, whole_text, written

SPARE = 4  # a tier has segments beyond what its largest set needs: one for so many, where h is 4 and more; 2 at least
BLOCK_SETS = 2048  # sets of a signature that a task holds at once; beyond that they meet in pairs of blocks
MOST_BITS = 1 << 14  # of a bitmap; larger sets keep the same bound, which then lets more pairs through to the texts
FINE = 16  # times as long are the bitmaps of the last pairs: they miss about a seventieth of a similar pair's difference
DELETION, PARITY = 1, 2  # flags in a signature's lowest bits: of the first segment; parity of the tier's number
SIG_BITS = 40  # of a signature's bits that travel; its bucket gives more


def words_of(text: str) -> list[bytes]:
    """A-Z in lower case; runs of bytes other than space and U+0009-U+000D."""
    return text.encode().lower().split()


def shingles(words: list, n: int) -> set:
    """Distinct n-word shingles; the whole sequence if there are fewer words; empty without words."""
    if len(words) < n:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(n))))


def similar(a: set, b: set, percent: int) -> bool:
    """100 * intersection >= percent * union, for sets that are not empty."""
    if not a or not b or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(a & b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: list[bytes], n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(n, len(h))
    total = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + _mix(h[k : len(h) - size + 1 + k] + np.uint64(k))
    return np.unique(_mix(total))


@functools.cache
def tier(size: int) -> tuple[int, int, int]:
    """Number, smallest and largest size of the tier that holds ``size``; each starts 1.5 times as high as the last."""
    number, low = 0, 1
    while True:
        high = max(low + 1, low + (low + 1) // 2) - 1
        if size <= high:
            return number, low, high
        number, low = number + 1, high + 1


def most_different(size: int, percent: int) -> int:
    """Most shingles that a set of this size and a similar one, as large or larger, can differ in."""
    return (size + 100 * size // percent) * (100 - percent) // (100 + percent)


@functools.cache
def layout(high: int, percent: int) -> int:
    """Segments of a tier whose largest set has ``high`` shingles; none where only equal sets can be similar."""
    differ = most_different(high, percent)
    return differ + (max(2, differ // SPARE) if differ >= 4 else 0)


def spare_of(size: int, percent: int) -> int:
    """Segments of its own tier that a set of this size need not look for partners with: the bounds of the others add
    up to more than it can differ by (the first segment's bound is 2)."""
    segments = layout(tier(size)[2], percent)
    return max(0, segments - most_different(size, percent)) if segments else 0


def signatures(h: np.ndarray, percent: int) -> list[np.ndarray]:
    """Signatures of a set of shingle hashes, in its own tier and, near the tier's lower end, in the one below."""
    size, out = len(h), []
    number, low, high = tier(size)
    tiers = [(number, low, high)]
    if low > 1 and 100 * (low - 1) >= percent * size:
        tiers.append(tier(low - 1))
    for number, low, high in tiers:
        segments = layout(high, percent)
        if not segments:
            continue
        at = ((h >> np.uint64(24)) % np.uint64(segments)).astype(np.int64)
        element = _mix(h + np.uint64(0x51ED27))
        sums = np.zeros(segments, np.uint64)
        np.add.at(sums, at, element)
        base = np.arange(segments, dtype=np.uint64) + np.uint64(number << 20)
        flags = np.uint64((number & 1) * PARITY)
        signed = _mix(sums + _mix(base)) & ~np.uint64(7) | flags
        first = element[at == 0]
        near = _mix(sums[0] - first + _mix(base[:1])) & ~np.uint64(7) | flags | np.uint64(DELETION)
        signed[0] |= np.uint64(DELETION)
        out += [signed, near]
    return out


def bitmap(h: np.ndarray, times: int = 1) -> bytes:
    """A bit for each hash, flipped as often as it is met; as many bits as hashes, rounded to a power of two: unrelated
    sets differ in a third of them and more, similar ones (0.8) in two ninths at most. ``times`` as many make the count
    of different bits the truer."""
    bits = times * min(MOST_BITS, max(64, 1 << round(np.log2(len(h)))))
    odd = np.bincount((h >> np.uint64(9)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def bitmaps(maps: list[bytes], shorter: int = 1) -> np.ndarray:
    """Bitmaps as rows of words, folded to the shortest one's length, or to ``shorter`` times less."""
    width = max(8, min(map(len, maps)) // shorter)
    rows = []
    for m in maps:
        while len(m) > width:
            half = len(m) // 2
            m = (int.from_bytes(m[:half], "little") ^ int.from_bytes(m[half:], "little")).to_bytes(half, "little")
        rows.append(m)
    return np.frombuffer(b"".join(rows), np.uint64).reshape(len(maps), -1)


def _sets(n: int, percent: int):
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            sizes, keys, maps = [], [], []
            for text in texts:
                h = shingle_hashes(words_of(text.as_py()), n)
                sizes.append(len(h))
                maps.append(bitmap(h) if len(h) else None)
                keys.append(xxhash.xxh3_64_intdigest(h.tobytes()) - 2**63 if len(h) else None)
            spare = [spare_of(s, percent) if s else 0 for s in sizes]
            parity = [(tier(s)[0] & 1) * PARITY if s else 0 for s in sizes]
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(spare, pa.int32()), pa.array(parity, pa.int32()), pa.array(maps, pa.binary())], names=["doc_id", "n", "key", "spare", "parity", "map"])

    return run


def _signed(n: int, percent: int, buckets: int, chunk_rows: int = 1_500_000, hot_share: float = 0.02):
    """Signatures of a chunk of documents, by bucket: sorted arrays of signatures and keys, one row a bucket.

    A signature that more than ``hot_share`` of a chunk's sets have leaves the arrays: its members become plain rows
    (bucket -1), and one marked entry tells the bucket. So no bucket grows with a group of near copies.
    """
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
    names = ["bucket", "sigs", "keys", "sig", "key"]

    def finish(parts, keys, sizes):
        sig = np.concatenate(parts)
        key = np.repeat(np.array(keys, np.int64), sizes)
        bucket = (sig >> np.uint64(SIG_BITS)).astype(np.int64) % buckets
        short = sig & np.uint64(2**SIG_BITS - 1) | (bucket.astype(np.uint64) << np.uint64(SIG_BITS))
        order = np.argsort(short, kind="stable")
        short, key = short[order], key[order]
        first = np.flatnonzero(np.r_[True, short[1:] != short[:-1]])
        count = np.diff(np.r_[first, len(short)])
        often = np.repeat(count > max(64, hot_share * len(keys)), count)
        if often.any():
            for start in range(0, int(often.sum()), 100_000):
                s, k = (v[often][start : start + 100_000] for v in (short.view(np.int64), key))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), -1, np.int32)), pa.nulls(len(s), pa.binary()), pa.nulls(len(s), pa.binary()), pa.array(s), pa.array(k)], names=names)
            marks = np.unique(short[often])
            short, key = np.r_[short[~often], marks], np.r_[key[~often], np.full(len(marks), HOT, np.int64)]
            order = np.argsort(short, kind="stable")
            short, key = short[order], key[order]
        cuts = np.searchsorted(short, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(SIG_BITS))
        low = np.ascontiguousarray(short.astype("<u8")[:, None].view(np.uint8)[:, : SIG_BITS // 8])
        rows = [(b, low[x:y].tobytes(), key[x:y].tobytes(), None, None) for b, (x, y) in enumerate(zip(cuts, cuts[1:])) if y > x]
        for start in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[start : start + 64]), kinds)], names=names)

    def run(batches):
        parts, keys, sizes, known, total = [], [], [], set(), 0
        for batch in batches:
            for text in batch.column(0):
                h = shingle_hashes(words_of(text.as_py()), n)
                key = xxhash.xxh3_64_intdigest(h.tobytes()) - 2**63
                found = signatures(h, percent) if len(h) and key not in known else []
                if found:
                    known.add(key)
                    own = np.unique(np.concatenate(found))
                    parts.append(own)
                    keys.append(key)
                    sizes.append(len(own))
                    total += len(own)
                if total > chunk_rows:
                    yield from finish(parts, keys, sizes)
                    parts, keys, sizes, known, total = [], [], [], set(), 0
        if parts:
            yield from finish(parts, keys, sizes)

    return run


BUCKET_SIGNATURES = 1_000_000  # in about as many sets' signatures a task can hold
HOT = -(2**63)  # stands for the plain rows of a signature


def _shared(table: pa.Table) -> pa.Table:
    """Signatures of a bucket with two sets and more: a row for each (signature, key), with how many there are."""
    width = SIG_BITS // 8
    raw = np.frombuffer(b"".join(table.column("sigs").to_pylist()), np.uint8).reshape(-1, width)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :width] = raw
    bucket = np.uint64(table.column("bucket")[0].as_py())
    sig = wide.view("<u8").ravel() | bucket << np.uint64(SIG_BITS)
    key = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.int64)
    order = np.lexsort((key, sig))
    sig, key = sig[order], key[order]
    once = np.r_[True, (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])]
    sig, key = sig[once], key[once]
    first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
    count = np.diff(np.r_[first, len(sig)])
    marked = np.repeat(key[first] == HOT, count)
    n = np.repeat(count, count) + marked * 1_000_000_000
    keep = ((n > 1) & (key != HOT)) if len(n) else np.zeros(0, bool)
    return pa.table({"sig": sig[keep].view(np.int64), "key": key[keep], "n": n[keep].astype(np.int64)})


def _keyed(n: int):
    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            keys = [xxhash.xxh3_64_intdigest(shingle_hashes(words_of(t.as_py()), n).tobytes()) - 2**63 for t in texts]
            keep = pa.array([k == w for k, w in zip(keys, batch.column(0).to_pylist())], pa.bool_())
            yield batch.filter(keep)

    return run


def _fine(n: int):
    def run(batches):
        for batch in batches:
            maps = [bitmap(shingle_hashes(words_of(t.as_py()), n), FINE) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(maps, pa.binary())], names=["key", "map"])

    return run


def _verified(n: int, percent: int):
    def run(batches):
        known: dict = {}

        def grams(key, text):
            if key not in known:
                if len(known) > 64:
                    known.clear()
                known[key] = shingles(words_of(text.as_py()), n)
            return known[key]

        for batch in batches:
            a, b, first, second = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)
            ok = [similar(grams(x, first[k]), grams(y, second[k]), percent) for k, (x, y) in enumerate(zip(a, b))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    return run


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels (``node, label``) after further links between their components."""
    if labels is None:
        return graph.components(links)
    to = labels.withColumnRenamed("label", "own")
    named = links.join(to.withColumnRenamed("node", "a"), "a", "left").select(F.coalesce("own", "a").alias("a"), "b")
    named = named.join(to.withColumnRenamed("node", "b"), "b", "left").select("a", F.coalesce("own", "b").alias("b"))
    found = graph.components(named)
    old = labels.join(found.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    made = written(old.union(found.join(old.select("node"), "node", "left_anti")))
    released(found, labels)
    return made


def _wide(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` that are links."""
    one = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("first")), "a")
    two = one.join(texts.select(F.col("key").alias("b"), F.col("text").alias("second")), "b").select("a", "b", "first", "second")
    return two.mapInArrow(_verified(n, percent), "a long, b long, ok boolean")


def _dealt(own: DataFrame, grid: bool) -> DataFrame:
    """Members (``sig, key, label, size, weight, asks``) with their bitmaps, dealt by signature and pair of blocks ``i, j``.

    Most signatures have one block. Those with more give each member to all pairs of its block, or (not ``grid``) to
    its own block alone.
    """
    n = partitions_for(own.sparkSession)
    counts = own.groupBy("sig").agg(F.ceil(F.count("*") / F.lit(BLOCK_SETS)).cast("int").alias("blocks")).where("blocks > 1")
    placed = own.join(F.broadcast(counts) if counts.count() < 10_000 else counts, "sig", "left")
    block = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).otherwise(F.lit(0))
    placed = placed.withColumn("block", block)
    with_ = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)) if grid else F.col("block")
    cells = placed.withColumn("with", with_).select("sig", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "key", "label", "size", "weight", "asks", "map")
    return cells.repartition(n, "sig", "i", "j").sortWithinPartitions("sig", "i", "j", "key")


SMALL_CELL = 64  # members of a cell whose pairs are laid out together with those of other cells


def _near(percent: int, mode: str):
    """Pairs of a cell's members whose bitmaps allow a link: with its hub ("hub"), each member's least ("least"), "all";
    or ("any") the members that have any such pair, each beside itself. "all" takes the longer bitmaps, and holds what
    passes these when folded against their whole length."""

    def room(a, b):
        return (a + b) * (100 - percent) // (100 + percent)

    def within(x, y, size, maps):
        """Which pairs of members ``x, y`` have bitmaps that allow a link, at the shorter one's length."""
        used = np.unique(np.concatenate([x, y]))
        width = np.array([len(maps[k]) for k in used.tolist()], np.int64)
        place = np.zeros(len(size), np.int64)
        place[used] = np.arange(len(used))
        least = np.minimum(width[place[x]], width[place[y]])
        ok = np.zeros(len(x), bool)
        for w in np.unique(least).tolist():
            mine = np.flatnonzero(least == w)
            rows = np.unique(np.concatenate([x[mine], y[mine]]))
            words = bitmaps([*(maps[k] for k in rows.tolist()), b"\0" * w])
            at = np.zeros(len(size), np.int64)
            at[rows] = np.arange(len(rows))
            step = max(1, 2_000_000 // words.shape[1])
            for start in range(0, len(mine), step):
                part = mine[start : start + step]
                a, b = x[part], y[part]
                ok[part] = np.bitwise_count(words[at[a]] ^ words[at[b]]).sum(1, dtype=np.int64) <= room(size[a], size[b])
        return ok

    def partners(key, label, size, weight, asks, block, maps):
        words = bitmaps(maps, FINE if mode == "all" else 1)
        crossing = (block != block[0]).any()

        def allowed(x):
            ok = (label[x][:, None] != label[None, :]) & (asks[x][:, None] | asks[None, :])
            if crossing:
                ok &= block[x][:, None] != block[None, :]
            most = room(size[x][:, None], size[None, :])
            ok &= np.abs(size[x][:, None] - size[None, :]) <= most
            apart = np.zeros(most.shape, np.int32)
            for k in range(words.shape[1]):
                apart += np.bitwise_count(words[x, k][:, None] ^ words[None, :, k])
            return ok & (apart <= most)

        step = max(1, 4_000_000 // max(1, len(key)))
        left = np.arange(len(key))
        if mode in ("hub", "any"):
            best = np.lexsort((key, weight))[::-1]
            hubs = best[np.unique(block[best], return_index=True)[1]]  # of each block
            ok = allowed(hubs)
            at, met = np.nonzero(ok)
            if mode == "hub":
                return key[met], key[hubs[at]]
            found = set(key[met].tolist()) | set(key[hubs[at]].tolist())
            left = np.flatnonzero(~ok.any(0))
        elif len(left):
            names, count = np.unique(label, return_counts=True)
            left = np.flatnonzero(label != names[count.argmax()])  # pairs are found from either side
        if mode != "least" and asks.sum() < len(left):
            left = np.flatnonzero(asks)  # one of each pair asks
        out = [[], []]
        for start in range(0, len(left), step):
            x = left[start : start + step]
            ok = allowed(x)
            if mode == "any":
                found.update(key[x[ok.any(1)]].tolist())
                found.update(key[ok.any(0)].tolist())
            elif mode == "least":
                some = np.flatnonzero(ok.any(1))
                out[0].append(key[x[some]])
                out[1].append(key[ok[some].argmax(1)])  # members are in order of their keys
            else:
                a, b = np.nonzero(ok)
                a = x[a]
                good = within(a, b, size, maps)
                out[0].append(key[a[good]])
                out[1].append(key[b[good]])
        if mode == "any":
            own = np.array(sorted(found), np.int64)
            return own, own
        return tuple(np.concatenate(v) if v else np.zeros(0, np.int64) for v in out)

    def together(first, count, key, label, size, weight, asks, maps):
        """Pairs of many small cells at once: rows ``first[c]`` to ``first[c] + count[c]`` are a cell."""
        lows, highs = [], []
        for n in np.unique(count).tolist():  # at most SMALL_CELL sizes
            starts = first[count == n]
            if mode == "hub":
                rows = starts[:, None] + np.arange(n)
                hub = rows[np.arange(len(rows)), weight[rows].argmax(1)]
                x, y = np.repeat(hub, n), rows.ravel()
                x, y = np.minimum(x, y), np.maximum(x, y)
            else:
                i, j = np.triu_indices(n, 1)
                x, y = (starts[:, None] + i).ravel(), (starts[:, None] + j).ravel()
            good = (label[x] != label[y]) & (asks[x] | asks[y])
            x, y = x[good], y[good]
            good = np.abs(size[x] - size[y]) <= room(size[x], size[y])
            lows.append(x[good])
            highs.append(y[good])
        x, y = np.concatenate(lows), np.concatenate(highs)
        ok = within(x, y, size, maps)
        x, y = x[ok], y[ok]
        if mode == "any":
            own = np.unique(key[np.concatenate([x, y])])
            return own, own
        if mode == "least" and len(x):  # x is the lesser key: each member's least partner in its cell
            cell = np.searchsorted(first, np.concatenate([y, x]), side="right")
            member, partner = np.concatenate([y, x]), np.concatenate([x, y])
            order = np.lexsort((key[partner], member, cell))
            once = np.r_[True, np.diff(member[order]) != 0]
            return key[member[order][once]], key[partner[order][once]]
        return key[x], key[y]

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None or not len(held) else pa.concat_tables([held, table]).combine_chunks()
            if len(held) >= 20_000:
                yield from cells(held, False)
                held = held.slice(_last_cell(held))
        if held is not None:
            yield from cells(held, True)

    def cells(table, to_end):
        stop = len(table) if to_end else _last_cell(table)
        if not stop:
            return
        names = ("sig", "i", "j", "block", "key", "label", "size", "weight", "asks")
        sig, i, j, *columns = (table.column(c).slice(0, stop).to_numpy(zero_copy_only=False) for c in names)
        block, key, label, size, weight, asks = columns
        asks = asks.astype(bool)
        maps = table.column("map").slice(0, stop).to_pylist()
        edges = np.r_[0, np.flatnonzero((sig[1:] != sig[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1, stop]
        first, count = edges[:-1], np.diff(edges)
        small = (count > 1) & (count <= SMALL_CELL) & (i[first] == j[first])
        out = [[], []]
        if small.any():
            for column, v in zip(out, together(first[small], count[small], key, label, size, weight, asks, maps)):
                column.append(v)
        for x, n in zip(first[~small].tolist(), count[~small].tolist()):
            if n > 1:
                c = slice(x, x + n)
                for column, v in zip(out, partners(key[c], label[c], size[c], weight[c], asks[c], block[c], maps[c])):
                    column.append(v)
        if out[0]:
            a, b = map(np.concatenate, out)
            once = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            for start in range(0, len(once), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(once[start : start + 100_000, k]) for k in (0, 1)], names=["a", "b"])

    return run


def _last_cell(table: pa.Table) -> int:
    """Where the last cell of a sorted table begins."""
    n = len(table)
    if not n:
        return 0
    same = np.ones(n, bool)
    for c in ("sig", "i", "j"):
        v = table.column(c).to_numpy(zero_copy_only=False)
        same &= v == v[-1]
    return int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0


def _asking(shared: DataFrame) -> DataFrame:
    """Members (``sig, key, size, weight, asks``) of ``shared`` (``sig, key, n, size, spare, parity``; ``n`` sets have a
    signature): which signatures of its own tier a set looks for partners with.

    A set skips the ``spare`` most frequent of its segments, or the first segment, whose bound is 2, and all but two of
    these, whichever leaves it fewer partners. A first segment of one shingle or none is near the empty one, which a
    fixed share of all sets has, so a group of sets that ask there would grow with the corpus, and its pairs as the square.
    """
    flag = F.col("sig").bitwiseAND(F.lit(DELETION)) == DELETION
    own_tier = F.col("sig").bitwiseAND(F.lit(PARITY)) == F.col("parity")
    tiers = shared.withColumns({"own": own_tier, "whole": own_tier & ~flag})
    rank = F.row_number().over(Window.partitionBy("key", "whole").orderBy(F.desc("n"), "sig"))
    ranked = tiers.withColumns({"rank": rank, "weight": F.count("*").over(Window.partitionBy("key", "whole"))})
    gain = F.when(F.col("own") & ~F.col("whole"), F.col("n")).when(F.col("whole") & F.col("rank").between(F.col("spare") - 1, F.col("spare")), -F.col("n"))
    without = (F.col("spare") >= 2) & (F.coalesce(F.sum(gain).over(Window.partitionBy("key")), F.lit(0)) > 0)  # the first segment
    asks = F.when(F.col("whole"), F.col("rank") > F.col("spare") - F.when(F.col("without"), 2).otherwise(0)).otherwise(F.col("own") & ~F.col("without"))
    return ranked.withColumn("without", without).select("sig", "key", "size", "weight", asks.alias("asks"))


def link(docs: DataFrame, n: int = 3, percent: int = 90, hubs: int = 2) -> DataFrame:
    """Per row ``doc_id, n_shingles long, component_id long``: the smallest id reachable by links, itself included.

    Rows with a null or empty text, or without words, are linked with nothing. Rows that share an id are one vertex.
    Rows with a null id take no part: their component is null. Equal sets are grouped by a 64-bit hash of the set
    before the join; links between different sets are verified on the words themselves. Repeated rows stay.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    sets = written(narrow.mapInArrow(_sets(n, percent), "doc_id long, n long, key long, spare int, parity int, map binary"))
    named = narrow.where("doc_id IS NOT NULL")
    shingles_in_all = sets.agg(F.sum("n")).first()[0] or 0
    buckets = max(4 * partitions_for(docs.sparkSession), int(shingles_in_all * (100 - percent) // 100 // BUCKET_SIGNATURES))
    arrays = written(named.select("text").mapInArrow(_signed(n, percent, buckets), "bucket int, sigs binary, keys binary, sig long, key long"))
    met = arrays.where("bucket >= 0").select("bucket", "sigs", "keys").groupBy("bucket").applyInArrow(_shared, "sig long, key long, n long")
    hot = arrays.where("bucket < 0").select("sig", "key").distinct().withColumn("n", F.lit(2_000_000_000).cast("long"))
    first_of = sets.where("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("node"), F.max("n").alias("size"), F.max("spare").alias("spare"), F.max("parity").alias("parity"), F.first("map").alias("map"))
    first_of = written(first_of)
    members = written(_asking(met.union(hot).join(first_of.select("key", "size", "spare", "parity"), "key")))
    released(arrays)
    maps = first_of.select("key", "map")

    def split(own: DataFrame, by: str) -> DataFrame:
        """Members of signatures that hold more than one ``by`` and ask for partners."""
        some = own.groupBy("sig").agg(F.min(by).alias("low"), F.max(by).alias("high"), F.max("asks").alias("any")).where("low <> high AND any")
        return own.join(some.select("sig"), "sig", "left_semi")

    # members without any pair that the bitmaps allow drop out before a text moves
    first = written(split(members, "key").withColumn("label", F.col("key")).join(maps, "key"))
    released(members)
    alive = written(_dealt(first, True).mapInArrow(_near(percent, "any"), "a long, b long").select(F.col("a").alias("key")).distinct())
    own = written(split(first.join(alive, "key", "left_semi"), "key"))
    released(first, alive)
    wanted = own.select("key").distinct().join(first_of.select("key", "node"), "key").select("key", F.col("node").alias("doc_id"))
    texts = named.join(wanted.hint("shuffle_hash"), "doc_id").select("key", "text").mapInArrow(_keyed(n), "key long, text string").dropDuplicates(["key"])
    texts = written(texts)

    labels, tested, pasts = None, None, []
    modes = ["hub"] * hubs + ["least"]
    while own.limit(1).count():
        mode = modes.pop(0) if modes else "all"
        if mode == "all":  # the members that still have pairs, with longer bitmaps
            alive = written(_dealt(own, True).mapInArrow(_near(percent, "any"), "a long, b long").select(F.col("a").alias("key")).distinct())
            fine = written(texts.join(alive, "key", "left_semi").select("key", "text").mapInArrow(_fine(n), "key long, map binary"))
            before, own = own, written(split(own.join(alive, "key", "left_semi"), "label").drop("map").join(fine, "key"))
            released(before, alive, fine)
        some = own
        if mode == "hub" and labels is not None:  # one member stands for its component
            some = own.groupBy("sig", "label").agg(F.max_by(F.struct("key", "size", "weight", "asks", "map"), "weight").alias("m")).select("sig", "label", "m.*")
        pairs = _dealt(some, mode != "hub").mapInArrow(_near(percent, mode), "a long, b long").distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        seen = written(_wide(pairs, texts, n, percent))
        pasts.append(seen)
        tested = seen.select("a", "b") if tested is None else tested.union(seen.select("a", "b"))
        links = seen.where("ok").select("a", "b")
        if links.limit(1).count():
            labels = _merged(labels, links)
            if mode == "least":
                modes = ["least"]
            now = own.drop("label").join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
            before, own = own, written(split(now, "label"))
            released(before)
        if mode == "all":
            break
    released(own, texts, *pasts)

    same = sets.where("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.collect_set("key").alias("keys")).where("a <> b")
    more = written(same.select("a", F.explode("keys").alias("b")).where("a <> b"))
    if more.limit(1).count():
        labels = _merged(labels, more)
    if labels is None:
        top = first_of.select("key", F.col("node").alias("component_id"))
    else:
        at = first_of.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
        least = at.groupBy("label").agg(F.min("node").alias("component_id"))
        top = at.join(least, "label").select("key", "component_id")
    top = written(top)
    released(labels, more, first_of)
    linked = sets.where("key IS NOT NULL AND doc_id IS NOT NULL").join(top, "key").select("doc_id", "n", "component_id")
    alone = sets.where("key IS NULL OR doc_id IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.union(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def first_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest id, one row of it if the id is repeated.

    Rows with a null id stay, as do rows without words (one of each id).
    """
    groups = link(docs, n, percent)
    stay = written(groups.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("rows")))
    free = free_names(docs.columns, "id", "rows", "place")
    named = stay.select(F.col("doc_id").alias(free["id"]), F.col("rows").alias(free["rows"]))
    kept = docs.join(named.hint("shuffle_hash"), F.col("doc_id").cast("long") == F.col(free["id"]), "inner")
    once = kept.where(F.col(free["rows"]) == 1).select(*docs.columns)
    if not stay.where("rows > 1").limit(1).count():
        return once.union(docs.where("doc_id IS NULL"))
    order = Window.partitionBy(free["id"]).orderBy(F.length(F.coalesce("text", F.lit(""))).desc(), F.xxhash64("text"))
    again = kept.where(F.col(free["rows"]) > 1).withColumn(free["place"], F.row_number().over(order)).where(F.col(free["place"]) == 1)
    return once.union(again.select(*docs.columns)).union(docs.where("doc_id IS NULL"))
