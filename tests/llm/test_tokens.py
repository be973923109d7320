"""Token counts and BPE against plain forms."""

import hashlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillsieve.llm import bpe_codec, queries, token_counts

from .helpers import collected, odd_docs

BYTES, WORDS = queries.tokenizer_file("byte_bpe_50k.json"), queries.tokenizer_file("word_bpe_49k.json")


def greedy(word: bytes, first: set, later: set) -> int:
    n, at = 0, 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in (later if at else first)), None)
        if end is None:
            return 1
        n, at = n + 1, end
    return n


@pytest.mark.parametrize("first, later", [([b"a", b"ab", b"abcd"], [b"c", b"b", b"cd", b"bc", b"d"]), ([b"a"], [b"a", b"aaa"]), ([], [b"a"]), ([b"ab"], [])])
def test_automaton(first, later):
    import itertools

    a = token_counts.build(first, later)
    for n in range(7):
        for word in map(bytes, itertools.product(b"abcd", repeat=n)):
            assert a.count(word) == greedy(word, set(first), set(later))


def test_token_counts(spark):
    docs = odd_docs(spark)
    vocabulary = token_counts.byte_level_vocabulary(BYTES)
    first, later = map(set, vocabulary)
    got = sorted(map(tuple, token_counts.count_tokens(docs, vocabulary).collect()), key=repr)
    want = sorted(((i, len(w), sum(greedy(x, first, later) for x in w)) for i, t in collected(docs) for w in [(t or "").encode().split()]), key=repr)
    assert got == want
    assert token_counts.count_tokens(docs.limit(0), vocabulary).count() == 0


def test_bpe_equals_the_library(spark):
    own = Tokenizer.from_file(WORDS)
    own.no_truncation(), own.no_padding()
    extra = ["a\x1cb \x85 c᠎d", "I'LL <|endoftext|>Foo<|startoftext|> <|x", "ΑΣ ΣΑΣ İstanbul ﬁ é", "aaaaaaaa!!!!???\n\n'S'T's", "½ ² Ⅷ 🎉🎉 한국", "\x00\x7f﻿"]
    docs = odd_docs(spark).select("doc_id", "text").union(spark.createDataFrame([(900 + k, t) for k, t in enumerate(extra)], "doc_id long, text string"))
    texts = collected(docs)
    encoded = sorted(((i, own.encode(t or "", add_special_tokens=False).ids) for i, t in texts), key=repr)
    rows = bpe_codec.encode(docs, WORDS, slice_chars=5000).collect()
    assert sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in rows), key=repr) == encoded
    assert all(r.decoded == own.decode(np.frombuffer(r.ids, "<u4").tolist(), skip_special_tokens=False) for r in rows)
    want = sorted(((i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(own.decode(x, skip_special_tokens=False).encode()).hexdigest()) for i, x in encoded), key=repr)
    assert sorted(map(tuple, bpe_codec.digests(docs, WORDS).collect()), key=repr) == want
    assert bpe_codec.digests(docs.limit(0), WORDS).count() == 0


def test_registered(spark, sf):
    """The registered queries' own results on whole tables, against the library and the plain greedy count."""
    own = Tokenizer.from_file(WORDS)
    own.no_truncation(), own.no_padding()
    docs = collected(spark.read.parquet(f"{sf}/documents.parquet"))
    want = []
    for i, t in docs:
        ids = own.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, queries.op4_bpe_codec(spark, sf).collect())) == sorted(want)
    first, later = map(set, token_counts.byte_level_vocabulary(BYTES))
    known: dict = {}
    for _, t in docs:
        known.update((w, greedy(w, first, later)) for w in set((t or "").encode().split()).difference(known))
    want = [(i, len(w), sum(map(known.__getitem__, w))) for i, t in docs for w in [(t or "").encode().split()]]
    assert sorted(map(tuple, queries.op1_token_counts(spark, sf).collect())) == sorted(want)
