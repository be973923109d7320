"""Token counts by a linear longest-match automaton.

A vocabulary of word-initial and continuation pieces becomes two tries joined by failure links. Each node stores
how many pieces are popped when its link is followed, so a word is counted in one pass over its bytes, without
backtracking and without building the pieces. Greedy longest match from the left, as word-piece models define it:
a word with a rest that no piece matches is one unknown token.
"""

from __future__ import annotations

import json
import uuid
from collections import deque
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common


@dataclass(frozen=True)
class Automaton:
    """``step[node << 8 | byte]`` is the next node; ``link[node]`` the failure node (-1: none); ``popped[node]`` a count."""

    step: dict
    link: list
    popped: list

    def count(self, word: bytes) -> int:
        """Pieces of one word; 1 if it has an unmatched rest; 0 if empty."""
        step, link, popped = self.step, self.link, self.popped
        node, n = START, 0
        for byte in word:
            while (to := step.get(node << 8 | byte)) is None:
                n += popped[node]
                node = link[node]
                if node < 0:
                    return 1
            node = to
        while node != REST and word:
            n += popped[node]
            node = link[node]
            if node < 0:
                return 1
        return n


START, REST = 0, 1


def build(initial: list[bytes], continuation: list[bytes]) -> Automaton:
    """The automaton of a vocabulary: pieces that may start a word, and pieces that may continue one."""
    step, final, kids = {}, [False, False], [[], []]
    for root, pieces in ((START, initial), (REST, continuation)):
        for piece in pieces:
            node = root
            for byte in piece:
                key = node << 8 | byte
                if key not in step:
                    step[key] = len(final)
                    kids[node].append(byte)
                    final.append(False)
                    kids.append([])
                node = step[key]
            if node != root:
                final[node] = True
    link, popped = [-1] * len(final), [0] * len(final)
    queue = deque((START, REST))
    while queue:
        above = queue.popleft()
        for byte in kids[above]:
            node = step[above << 8 | byte]
            if final[node]:
                link[node], popped[node] = REST, 1
            else:
                at, n = link[above], popped[above]
                while at >= 0 and (at << 8 | byte) not in step:
                    n += popped[at]
                    at = link[at]
                if at >= 0:
                    link[node], popped[node] = step[at << 8 | byte], n
            queue.append(node)
    return Automaton(step, link, popped)


def byte_alphabet() -> dict[str, int]:
    """The usual byte-level alphabet: printable bytes stand for themselves, the others for 256 and up in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def byte_level_vocabulary(path: str) -> tuple[list[bytes], list[bytes]]:
    """Pieces of a byte-level BPE file: those that start with its space mark begin a word, the others continue one."""
    with open(path) as f:
        pieces = json.load(f)["model"]["vocab"]
    to_byte = byte_alphabet()
    space = next(c for c, b in to_byte.items() if b == 32)
    first, later = [], []
    for piece in pieces:
        if all(c in to_byte for c in piece):
            mark = piece.startswith(space)
            (first if mark else later).append(bytes(to_byte[c] for c in piece[mark:]))
    return [p for p in first if p], later


_CACHE: dict = {}


def count_tokens(docs: DataFrame, vocabulary: tuple[list[bytes], list[bytes]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``n_words long`` and ``n_tokens long`` of its whole text.

    Words are runs of bytes other than space and U+0009-U+000D. A null or empty text has 0 of either. Repeated rows
    and null ids stay, one result each; other columns are not read. The vocabulary is of fixed size and is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    token = uuid.uuid4().hex  # a worker process keeps automaton and cache from task to task of one call

    def run(batches):
        if token not in _CACHE:
            _CACHE.clear()
            _CACHE[token] = build(*shared.value), common.WordCache()
        automaton, cache = _CACHE[token]
        for batch in batches:
            texts, words, tokens = batch.column(1), [], []
            for i in range(len(texts)):
                found = texts[i].as_py().encode().split()
                new = cache.missing(found)
                known = cache.put(new, map(automaton.count, new))
                words.append(len(found))
                tokens.append(sum(map(known.__getitem__, found)))
                cache.turn()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["id", "n_words", "n_tokens"])

    narrow = docs.select(docs[id_col].cast("long").alias("id"), common.whole_text(text_col).alias("text"))
    return narrow.mapInArrow(run, "id long, n_words long, n_tokens long").withColumnRenamed("id", id_col)
