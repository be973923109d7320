"""BPE encoding and decoding with a pair occurrence index.

The distinct words of a slice of a partition lie in one symbol array. An index maps each mergeable pair (by its
rank) to all its positions there; active ranks are applied in ascending order, leftmost position first, and each
merge updates the lists of the pairs beside it. Words are independent, so the global order by rank gives each word
the merges that it would get alone.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from . import common
from .token_counts import byte_alphabet

#: White space of the normaliser, which str.split() also takes but for U+001C-U+001F.
SPACE = regex.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
NOT_SPACE = regex.compile("[\\x1c-\\x1f]")


@dataclass
class Codec:
    """A tokenizer file as plain tables: pieces by id, byte symbols, merges sorted by pair, special strings."""

    pieces: list
    first: np.ndarray  # symbol of a byte inside a word
    last: np.ndarray  # symbol of a byte that ends a word
    pairs: np.ndarray  # a << 32 | b, sorted
    ranks: np.ndarray  # rank of each of these pairs
    made: list  # by rank: a, b, the merged symbol
    specials: dict
    words: regex.Pattern
    special_re: regex.Pattern | None

    def __post_init__(self):
        self.rank_of = dict(zip(self.pairs.tolist(), self.ranks.tolist()))

    def chunks(self, text: str) -> list[str]:
        """White-space separated parts of a text; special strings are parts of their own."""
        if self.special_re and "<" in text and self.special_re.search(text):
            return [c for part in self.special_re.split(text) for c in ([part] if part in self.specials else self._plain(part))]
        return self._plain(text)

    @staticmethod
    def _plain(text: str) -> list[str]:
        return [c for c in SPACE.split(text) if c] if NOT_SPACE.search(text) else text.split()

    def units(self, chunk: str) -> list[bytes]:
        """The words of a chunk as UTF-8: normalised, lower case, split by the pattern."""
        if chunk.isascii():
            chunk = chunk.lower()
        else:
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
        return [w.encode() for w in self.words.findall(chunk)]

    def encode_chunks(self, chunks: list[str]) -> list[tuple[bytes, str]]:
        """Per chunk its ids as little-endian unsigned 32-bit integers, and what they decode to."""
        units = [[c] if c in self.specials else self.units(c) for c in chunks]
        flat = list({u for us in units for u in us if isinstance(u, bytes)})
        known = dict(zip(flat, self.encode_words(flat)))
        out = []
        for us in units:
            ids = b"".join(known[u] if isinstance(u, bytes) else int(self.specials[u]).to_bytes(4, "little") for u in us)
            out.append((ids, self.decode(np.frombuffer(ids, "<u4").tolist())))
        return out

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder: pieces joined by a space, special ones included."""
        return " ".join(map(self.pieces.__getitem__, ids))

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each distinct word, by the pair occurrence index over all of them."""
        if not words:
            return []
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        base = self.first[raw]
        base[ends - 1] = self.last[raw[ends - 1]]
        n = len(base)
        inner = np.ones(n, bool)
        inner[ends - 1] = False
        at = np.flatnonzero(inner)
        keys = base[at] << 32 | base[at + 1]
        slot = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        hit = self.pairs[slot] == keys
        at, rank = at[hit], self.ranks[slot[hit]]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(np.diff(rank)) + 1
        index = dict(zip(rank[np.r_[0, cuts]].tolist(), (p.tolist() for p in np.split(at, cuts)))) if len(at) else {}
        active = list(index)
        heapq.heapify(active)
        symbol, rank_of, made = base.tolist(), self.rank_of, self.made
        after = np.where(inner, np.arange(1, n + 1), -1).tolist()  # next symbol of the word, -1 at its end
        starts = np.r_[0, ends[:-1]]
        before = np.arange(-1, n - 1)
        before[starts] = -1
        before = before.tolist()
        while active:
            r = heapq.heappop(active)
            a, b, c = made[r]
            places = index.pop(r)
            places.sort()
            for p in places:
                q = after[p]
                if symbol[p] != a or q < 0 or symbol[q] != b:
                    continue
                symbol[p], symbol[q] = c, -1
                after[p] = s = after[q]
                left = before[p]
                if s >= 0:
                    before[s] = p
                    new = rank_of.get(c << 32 | symbol[s])
                    if new is not None:
                        if new in index:
                            index[new].append(p)
                        else:
                            index[new] = [p]
                            heapq.heappush(active, new)
                if left >= 0:
                    new = rank_of.get(symbol[left] << 32 | c)
                    if new is not None:
                        if new in index:
                            index[new].append(left)
                        else:
                            index[new] = [left]
                            heapq.heappush(active, new)
        done = np.array(symbol, np.int64)
        alive = done >= 0
        upto = np.cumsum(alive)[ends - 1].tolist()
        ids = done[alive].astype("<u4").tobytes()
        return [ids[4 * x : 4 * y] for x, y in zip([0, *upto], upto)]


def load(path: str) -> Codec:
    """A tokenizer file of the kind: word-end suffix, byte-level symbols, no decoder."""
    with open(path) as f:
        spec = json.load(f)
    model = spec["model"]
    vocab, suffix = model["vocab"], model["end_of_word_suffix"]
    specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
    pieces = [""] * (1 + max([*vocab.values(), *specials.values()]))
    for piece, i in (vocab | specials).items():
        pieces[i] = piece
    first, last = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for c, b in byte_alphabet().items():
        first[b], last[b] = vocab[c], vocab[c + suffix]
    made = [(vocab[a], vocab[b], vocab[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
    keys = np.array([a << 32 | b for a, b, _ in made], np.int64)
    order = np.argsort(keys)
    pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    special_re = regex.compile("(" + "|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None
    return Codec(pieces, first, last, keys[order], order, made, specials, regex.compile(pattern), special_re)


_CODECS: dict = {}


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", slice_chars: int = 2_000_000) -> DataFrame:
    """Per row: the id, ``ids binary`` (little-endian unsigned 32-bit) and ``decoded string`` of its whole text.

    Null texts count as empty: no ids, empty decoded text. Repeated rows and null ids stay. Other columns are not
    read. The file is read on the driver; its tables, of fixed size, are broadcast. Memory: one Arrow batch and a
    bounded word cache.
    """
    codec = load(tokenizer_path)
    shared = docs.sparkSession.sparkContext.broadcast(codec)
    narrow = docs.select(docs[id_col].cast("long").alias("id"), common.whole_text(text_col).alias("text"))
    return narrow.mapInArrow(_encoder(shared, slice_chars, False), "id long, ids binary, decoded string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", slice_chars: int = 2_000_000) -> DataFrame:
    """As :func:`encode`, with ``n_tokens long`` and SHA-256 of ids and decoded text in place of them."""
    shared = docs.sparkSession.sparkContext.broadcast(load(tokenizer_path))
    narrow = docs.select(docs[id_col].cast("long").alias("id"), common.whole_text(text_col).alias("text"))
    return narrow.mapInArrow(_encoder(shared, slice_chars, True), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def _encoder(shared, slice_chars: int, hashed: bool):
    token = uuid.uuid4().hex  # a worker process keeps tables and cache from task to task of one call

    def run(batches):
        if _CODECS.get("of") != token:
            _CODECS.update(of=token, codec=shared.value, cache=common.WordCache(120_000))
        codec, cache = _CODECS["codec"], _CODECS["cache"]
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            sizes = pc.utf8_length(texts).to_pylist()
            for start, end in common.slices(sizes, slice_chars):
                parts = [codec.chunks(t) for t in texts.slice(start, end - start).to_pylist()]
                new = cache.missing(c for p in parts for c in p)
                known = cache.put(new, codec.encode_chunks(new))
                rows = [[], [], []]
                for part in parts:
                    found = [known[c] for c in part]
                    data, text = b"".join(x[0] for x in found), " ".join(x[1] for x in found)
                    if hashed:
                        rows[0].append(len(data) // 4)
                        rows[1].append(hashlib.sha256(data).hexdigest())
                        rows[2].append(hashlib.sha256(text.encode()).hexdigest())
                    else:
                        rows[0].append(data)
                        rows[1].append(text)
                cache.turn()
                if hashed:
                    columns, names = [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                else:
                    columns, names = [pa.array(rows[0], pa.binary()), pa.array(rows[1], pa.string())], ["id", "ids", "decoded"]
                yield pa.RecordBatch.from_arrays([ids.slice(start, end - start), *columns], names=names)

    return run
